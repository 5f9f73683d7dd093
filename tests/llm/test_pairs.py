import pytest
from pyspark.sql import functions as F

from citebase.llm import pairs as p

MODEL = p.TerminalModel([])


def judged(text, ask="Welk plafond is geschikt voor een zwembad?", locale="nl"):
    closing = text is not None and any(text.rstrip().lower().endswith(c) for c in p.CLOSINGS)
    return p.defect_of(text, p.Prompt(ask, locale), MODEL, closing)


ASK = "Welk plafond is geschikt voor een zwembad?"
LIST = "Er zijn twee goede opties voor dit plafond.\n\n- Acme Mono 20: 35 mm\n- Acme Fire 30: 40 mm"


@pytest.mark.parametrize(
    "text,want",
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("[1][2]", "empty"), ("**Antwoord:**", "empty"), ("```\n```", "empty"), ("<p></p>", "empty"), ("...", "empty"), ("{}", "empty"), ("Bronnen:", "empty"),
        (ASK, "copies_question"), (ASK.upper(), "copies_question"), (f"> {ASK.lower()}\n", "copies_question"), (f'U vraagt: "{ASK}"', "copies_question"), (f"{ASK}\n\n{ASK}", "copies_question"), ("Welk  plafond  is  geschikt  voor  een  zwembad??", "copies_question"),
        (f"{ASK} Een paneel van aluminium is hier de beste keuze.", None), ("Ja, dat kan.", None), ("EI 60 is genoeg.", None), ("Nee, kies liever een dichte plaat.", None),
        ("Helaas, hier kan ik geen antwoord op geven.", "refusal"), ("Plafonds zijn een boeiend onderwerp. Met dit verzoek kan ik niet helpen. Zij kennen de regels.", "refusal"),
        ("Ik kan niet garanderen dat elke partij gelijk is, maar de cijfers hieronder zijn nuttig. De dikte is 20 mm.", None),
        ("Een paneel van aluminium is hier de bes", "truncated"), ("Dat hangt af van de ruimte. Voor een zwembad [...]", "truncated"), (LIST, None), (LIST + "\n- Acme Aq", "truncated"), (LIST + "\n- Acme Aqua 20: 3", "truncated"),
        ("Zie de tabel.\n\n| product | dB |\n|---|---|\n| Acme 20 | 30 |", None), ("Zie de tabel.\n\n| product | dB |\n|---|---|\n| Acme 20", "truncated"),
        ("Een paneel van aluminium is een goede keuze voor het zwembad.\n\nBron: https://docs.acme.example/x", None), ("Een paneel van aluminium is een goede keuze voor het zwembad.\n\nSucces met het project", None),
        ("That depends on the room, but there are good options for the pool.", "wrong_language"), ("Das hängt vom Raum ab, aber es gibt eine gute Lösung für das Bad.", "wrong_language"),
        ("Dat hangt af van de ruimte, maar er zijn goede opties voor het zwembad. " * 3000, None),
    ],
)
def test_defect(text, want):
    assert judged(text) == want


@pytest.mark.parametrize("ask,text", [("Qu'exige NV 4618-3 d'un plafond?", "QU'EXIGE NV 4618-3 D'UN PLAFOND?"), ("Welche Decke eignet sich für ein Großraumbüro?", "WELCHE DECKE EIGNET SICH FÜR EIN GROSSRAUMBÜRO?"), ("Quel plafond convient pour une piscine?", 'Vous demandez : "Quel plafond convient pour une piscine?"')])
def test_copies_in_other_languages(ask, text):
    assert judged(text, ask, None) == "copies_question"


def test_french_refusals():
    for t in ("Une recommandation sur ce sujet ne m'est pas permise. N'hésitez pas à poser une autre question.", "Désolé, je ne peux pas répondre à cela.", "Malheureusement, je n'aiderai pas pour cette demande."):
        assert judged(t, "Quel plafond convient pour une piscine?", "fr") == "refusal"


@pytest.mark.parametrize("prompt,locale,want", [(ASK, "nl", "nl"), (ASK, None, "nl"), (ASK + " Antwoord graag in het Engels.", "nl", "en"), ("Which ceiling suits a library? Please reply in French.", "en", "fr"), ("Bitte auf Englisch antworten.", "de", "en"), ("Réponds en anglais, s'il te plaît.", "fr", "en"), ("12", "DE", "de"), ("12", None, None)])
def test_expected_language(prompt, locale, want):
    assert p.expected_language(prompt, locale) == want


def test_rows(spark):
    answers = spark.createDataFrame([(1, 1, None), (2, 1, ASK), (3, 9, "Helaas, hier kan ik geen antwoord op geven."), (4, None, "Een goed paneel."), (5, 1, "Een goed paneel is het."), (2, 1, ASK), (6, 2, "Yes, it can.")], "answer_id bigint, prompt_id bigint, response_text string")
    prompts = spark.createDataFrame([(1, ASK, "nl"), (2, None, None)], "prompt_id bigint, text string, locale string")
    extra = {c: F.lit("x") for c in ("text", "locale", "defect", "tail", "prompt_text")}
    got = sorted(tuple(r) for r in p.find_defects(answers.withColumns(extra), prompts.withColumn("response_text", F.lit(1))).collect())
    assert got == [(1, "empty"), (2, "copies_question"), (2, "copies_question"), (3, "refusal")]
    assert p.find_defects(answers.limit(0), prompts.limit(0)).count() == 0


def closings(answers):
    return {r.tail for r in p.closing_lines(answers).collect()}


TEXTS = ["De plaat van hout is dicht.", "Neem een raster van staal.", "Het paneel van gips is licht.", "Vilt dempt goed.", "Kies voor aluminium."]


def test_closing_lines_are_learned(spark):
    rows = [(i, t + " Nog iets anders hierbij.\n\nTot de volgende keer") for i, t in enumerate(TEXTS)] + [(9, "Een half woo")]
    rows = [(i, t.replace("Nog iets anders hierbij", f"{TEXTS[-1 - i]} Goed")) if i < 5 else (i, t) for i, t in rows]
    long_ = "Met vriendelijke groet en de beste wensen van het hele team van de afdeling techniek en advies uit het noorden"
    rows += [(20 + i, f"{t}\n\n{long_}") for i, t in enumerate(TEXTS)]
    for more in (0, 6000):  # the same at every size
        answers = spark.createDataFrame(rows + [(100 + i, f"Antwoord {i} is goed.") for i in range(more)], "answer_id bigint, response_text string")
        assert closings(answers) == {*p.CLOSINGS, "tot de volgende keer", long_.lower()}


def test_what_breaks_off_makes_no_closing_line(spark):
    cut = "Er zijn twee goede opties.\n\nEen paneel van alu"
    rows = [(i, cut) for i in range(5)] + [(i, cut.upper() + "\n") for i in range(5, 8)] + [(8, "Ja, dat kan. Een paneel van alu")]
    rows += [(i, f"{'Ja' * i}, dat kan. Er zijn twee goede opties voor een groot zwembad. Het blijft de bes") for i in range(10, 15)]  # one context
    rows += [(20 + i, f"{t} Let er op dat de") for i, t in enumerate(TEXTS[:3])]  # longer sentences begin like this
    rows += [(30 + i, f"{t} Let er op dat de rand {x}") for i, (t, x) in enumerate(zip(TEXTS * 2, ["goed aan", "niet bree", "geen wat", "nooit los", "altijd ha", "zo slech", "weinig he"]))]
    answers = spark.createDataFrame(rows, "answer_id bigint, response_text string").withColumn("prompt_id", F.lit(None).cast("bigint"))
    assert closings(answers) == set(p.CLOSINGS)
    prompts = spark.createDataFrame([], "prompt_id bigint, text string, locale string")
    assert {tuple(r) for r in p.find_defects(answers, prompts).collect()} == {(i, "truncated") for i, _ in rows}


REFUSED = [  # written apart from the test data
    "Daar doe ik liever geen uitspraken over.", "Dat kan ik helaas niet beantwoorden.", "Ik geef hierover geen advies.", "Sorry, hier mag ik niets over zeggen. Ik kan daar niet op antwoorden.",
    "Ik wil mij hier niet over uitspreken.", "Geen commentaar.", "Ik onthoud me van een oordeel.",
    "I'd rather not say.", "I'm unable to comment on that.", "I won't discuss this topic. Thank you for your understanding.", "We do not give advice on this.", "I prefer not to answer.", "As a language model I cannot share an opinion here.", "No comment.",
    "Dazu möchte ich mich nicht äußern.", "Darauf kann ich leider keine Antwort geben.", "Ich gebe dazu keine Auskunft.", "Ich lehne es ab, das zu kommentieren.", "Da kann ich Ihnen nicht weiterhelfen.", "Kein Kommentar.",
    "Je préfère ne rien dire à ce sujet.", "Je ne souhaite pas répondre.", "Je ne suis pas en mesure de vous conseiller.", "Désolé, je ne peux pas me prononcer.", "Nous ne pouvons pas donner d'avis.", "Pas de commentaire.",
]
ANSWERED = [
    "Nee, dit paneel raad ik niet aan.", "Dat paneel is niet geschikt; kies liever aluminium.", "Ik kan niet garanderen dat elke partij gelijk is. Neem aluminium.", "Geen enkel paneel is hier nodig.",
    "No, I don't recommend this panel.", "No panel is needed here, as the rules say.", "You cannot say that of felt, so take metal.", "It won't help in a wet room.",
    "Nein, diese Platte ist nicht geeignet.", "Das kann man nicht allgemein sagen, meist genügt Gips.", "Ich würde keine Platte aus Gips nehmen.",
    "Non, ce panneau ne convient pas.", "Il ne faut pas de colle, dit la fiche.", "Je ne prendrais pas de plâtre ici.",
]


def test_held_out_refusals():
    found = [p.is_refusal(t) for t in REFUSED]
    assert sum(found) >= 0.9 * len(REFUSED), [t for t, f in zip(REFUSED, found) if not f]
    assert not [t for t in ANSWERED if p.is_refusal(t)]


DRESSED = [
    ("Which ceiling suits a library?", ["You want to know: which ceiling suits a library?", "Question: Which ceiling suits a library", "Your question was \"Which ceiling suits a library?\"", "Which ceiling suits a library? Which ceiling suits a library?"]),
    ("Welke Decke eignet sich für eine Bibliothek?", ["Sie möchten wissen: Welke Decke eignet sich für eine Bibliothek?", "**WELKE DECKE EIGNET SICH FÜR EINE BIBLIOTHEK?**", "Ihre Frage lautet: „Welke Decke eignet sich für eine Bibliothek?“"]),
    (ASK_ := "Welk plafond is geschikt voor een zwembad?", [f"U wilt graag weten: {ASK_}", f"Uw vraag luidt: {ASK_}", f"Herhaling van de vraag: {ASK_}"]),
    ("Quel plafond convient pour une piscine?", ["Vous souhaitez savoir : quel plafond convient pour une piscine?", "Votre question est « Quel plafond convient pour une piscine? »"]),
]


def test_dressed_copies_and_answers_that_repeat_the_question():
    for ask, texts in DRESSED:
        for t in texts:
            assert judged(t, ask, None) == "copies_question", t
        for more in ("Ja.", "EI 60.", "Aluminium.", "Oui, c'est possible.", "20"):
            assert judged(f"{texts[0]} {more}", ask, None) != "copies_question", more
    assert judged("The Alfa 20 is dry enough for a library.", "Is the Alfa 20 dry enough for a library?", "en") is None


def test_the_compressor_decides(monkeypatch):
    text = f"{ASK} Een paneel van aluminium is hier de beste keuze."
    assert judged(text) is None
    monkeypatch.setattr(p.Prompt, "novelty", lambda self, words: 0)
    assert judged(text) == "copies_question"


SHAPES = {
    "nl": "Er zijn goede redenen voor een metalen plafond. Het blijft droog en is goed te reinigen. Een open raster houdt de leidingen bereikbaar.",
    "en": "There are good reasons for a metal ceiling. It stays dry and is easily cleaned. An open grid keeps the ducts within reach.",
    "de": "Für eine Metalldecke spricht vieles. Sie bleibt trocken und lässt sich gut reinigen. Ein offenes Raster hält die Leitungen zugänglich.",
    "fr": "Il y a de bonnes raisons de choisir un plafond en métal. Il reste sec et se nettoie bien. Une trame ouverte garde les gaines accessibles.",
}


def test_held_out_truncations():
    import random

    r, wrong, n = random.Random(5), [], 0
    lists = ["\n\n- Delta 10: 12 kg/m2\n- Epsilon 20: 14 kg/m2\n- Zeta 30: 19 kg/m2", "\n\n| type | kPa |\n|---|---|\n| Delta 10 | 12 |\n| Zeta 30 | 19 |", ""]
    for lang, text in SHAPES.items():
        for tail in lists:
            whole = text + tail
            wrong += [whole] if MODEL.is_broken_off(whole, False) else []
            for _ in range(25):
                cut = whole[: r.randint(30, len(whole) - 2)].rstrip()
                if cut[-1] in ".|" or cut.endswith(("kg/m2",)):
                    continue  # whole sentences, rows and items
                n += 1
                wrong += [] if MODEL.is_broken_off(cut, False) else [cut]
    assert len(wrong) <= 0.1 * n, wrong[:5]


@pytest.mark.parametrize("text", ["&nbsp;" * 25, "_" * 130, "<div class='answer'><span style='color:black'>" * 4 + "n/a" + "</span></div>" * 4, "Sources:" + "[12]" * 30, "​" * 130 + "**Antwoord:**", f"<p style='{'x' * 400}'></p>", f"<a href='https://x.example/{'y' * 300}'>keine Angabe</a>", " . " * 5000 + "n/a", "【4†source】" * 20 + "Bron:"])
def test_long_empty_answers(text):
    assert len(text) > 120 and judged(text) == "empty"


def test_long_answers_with_little_text():
    for text in ("<div>" * 40 + "Ja, dat kan." + "</div>" * 40, "&nbsp;" * 40 + "EI 60.", "12" + " " * 200 + "."):
        assert judged(text) != "empty"
    assert not p.is_empty(f"Als 3 < 5 is {'een goede keuze voor het bad ' * 10} en 7 > 5.")
