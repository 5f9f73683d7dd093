import random

import pytest
from pyspark.sql import functions as F

from citebase.llm import spam as s

PROSE = "Een architect uit de regio vroeg om een plafond dat vochtbestendig oogt zonder zichtbare naden. Reinigen kan met een vochtige doek, zolang er geen schuurmiddel wordt gebruikt."


@pytest.mark.parametrize(
    "text,want",
    [
        (PROSE, False), (PROSE * 500, False), (f"{PROSE}\n\n{PROSE}", False), ("Home | Producten | Projecten | Downloads | Contact\n\n" + PROSE, False),
        ("## Technische gegevens\nDikte: 20 mm\nDichtheid: 300 kg/m3\nWinddruk: 1,2 kPa\nRw: 30 dB", False), (PROSE + "\nwww.a.example/x\nhttps://b.example/y", False),
        ("Please note that a badly sealed perimeter quickly costs 18 dB of insulation. Please note that a badly sealed perimeter quickly costs 19 dB of insulation.", False),
        ("snelle plafonds prijs goedkope plafonds snelle plafonds prijs goedkope plafonds kopen. " * 20, True), ("\n".join(f"https://shop{i}.example/p/{i}" for i in range(40)), True), ("<ul>" + "".join(f'<li><a href="http://x.example/{i}">witte panelen {i}</a></li>' for i in range(20)) + "</ul>", True),
        ("#WittePlafonds #GoedkopePanelen #WittePlafonds #Aanbieding", True), ("\n".join(f"Acme Mono {i} - € {i} - witte panelen" for i in range(30)), True), ("\n".join(f"[baffles kopen](www.x.example/{i})" for i in range(20)) + "\n" + PROSE, True),
        ("Tags: wit, zwart, paneel", True), ("", False), (None, False), ("!!! ...", False),
    ],
)
def test_pages(text, want):
    assert bool(text and s.keyword_share(text) > s.SHARE) == want


OTHERS = {
    "es": "La empresa presentó ayer un nuevo panel para techos que reduce el ruido en las aulas. Según los técnicos, el material no se deforma con la humedad y se puede limpiar con un paño. Los vecinos de la escuela dicen que por fin se oye a la maestra desde la última fila. El precio depende de la medida y del color, pero no de la zona en la que se monta.",
    "it": "La ditta ha messo sul mercato un pannello che riduce il rumore nelle aule. Chi lo ha provato dice che non si piega con il caldo e che si pulisce con un panno. I tecnici del posto lo hanno visto in uso per più di un anno. Il costo non è alto, ma la posa va fatta da chi ne ha la pratica.",
    "pt": "A empresa lançou um painel que reduz o ruído nas salas de aula. Quem o usou diz que não se dobra com o calor e que se limpa com um pano. Os técnicos da zona já o viram em uso por mais de um ano. O custo não é alto, mas a obra tem de ser feita por quem sabe.",
    "sv": "Vi har sett att en ny platta är bra för rum med hög fukt. Den som har den i sin sal kan tvätta den med en våt duk och den tar inte upp så mycket ljud som man tror. Det är en av de få som går att ta ner och sätta upp på nytt.",
}


@pytest.mark.parametrize("lang", sorted(OTHERS))
def test_prose_of_other_languages_is_no_spam(lang):
    assert s.keyword_share(OTHERS[lang]) <= s.SHARE


@pytest.mark.parametrize("text", ["paneles baratos comprar, paneles blancos oferta, techos acústicos precio, paneles baratos comprar, techos acústicos precio, paneles blancos oferta. " * 8, "pannelli bianchi prezzo pannelli fonoassorbenti prezzo pannelli bianchi offerta controsoffitti prezzo pannelli bianchi prezzo controsoffitti offerta " * 6, "Etiquetas: techo, panel, blanco, negro, oferta", "techos | paneles | lamas | islas | perfiles | rejillas", "\n".join(f"[paneles en venta](https://x.example/{'y' * 400}/{i})" for i in range(20)) + "\nCompre hoy."])
def test_lists_of_other_languages_are_spam(text):
    assert s.keyword_share(text) > s.SHARE


def test_the_automaton_judges_lines_without_a_clause():
    once = "Steel gallery quartz meadow harbour violin copper lantern orchard pebble canyon thistle walnut glacier"
    assert s.keyword_share(once) == 0.0 and s.keyword_share(f"{once}\n{once}") == 1.0


def test_cover_against_brute_force():
    r = random.Random(7)
    for _ in range(200):
        w, least = [r.randrange(r.choice((2, 4, 30))) for _ in range(r.randint(0, 40))], r.choice((1, 1, 3))
        want = bytearray(len(w))
        for i in range(len(w)):
            for j in range(i + least, len(w) + 1):
                if sum(w[k : k + j - i] == w[i:j] for k in range(len(w) - (j - i) + 1)) >= 2:
                    want[i:j] = b"\1" * (j - i)
        assert s.repeated_cover(w, least) == want


def test_rows(spark):
    bad = "witte panelen kopen witte panelen prijs " * 30
    docs = spark.createDataFrame([(1, PROSE), (2, bad), (2, bad), (3, None), (4, "")], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("share", "words")})
    assert [r.doc_id for r in s.find_spam(docs).collect()] == [2, 2] and s.find_spam(docs.limit(0)).count() == 0
