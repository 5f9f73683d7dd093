"""Defective prompt and response pairs: empty, copies_question, refusal, truncated, wrong_language.

Copies are found by compression: every word is written as a code of ``CODE`` bytes, and a response that is nothing but its
prompt, however dressed, costs few bytes beside the prompt itself once prompt and dressing words are the zstandard
dictionary; any other word costs its whole code. Languages and refusals are told by dictionaries. Truncation is told by a
model of the terminal context (how the last line ends, what the lines before it look like, whether the last words recur as
a closing line), fitted on whole answers against the same answers broken off.
"""

from __future__ import annotations

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citebase.session import small

#: An unpunctuated closing line counts as complete if it ends at least so many different answers after different words, and
#: at least so large a share of the last sentences that begin with it end there: what is broken off begins longer ones.
CLOSING_CONTEXTS, CLOSING_SHARE = 3, 0.5
#: Bytes of a word's code, and bytes that a copy may cost more than its prompt: some jumps, but no other word.
CODE, NOVEL = 32, 24
#: Answers at most on which the model of terminal contexts is fitted, and broken-off copies made of each.
SAMPLE, CUTS = 2000, 3

#: Words of one of the four languages only.
LANGUAGE_WORDS = {
    "nl": "het een van heeft voor met wordt zijn niet op aan ook maar te zonder uit bij naar deze geen kan ik dat dit volgens haalt geldt ruim voldoende genoeg elke boven blijft kies om nee mag mits liever zit vooral want moet wie of hoe welk welke wat zoek helpen u uw",
    "en": "the of and has with that for from which was are this it can be at than more enough yes no take instead fine you your an as any when its says so how what where each",
    "de": "der das und für ist nicht von zu ein eine einen hat wird auf bei aus dem den zwischen nein geht genügt wenn erlaubt oder man sich gilt laut mit reicht völlig als wer den besser dass noch auch wie sie ihre ihr im zur zum",
    "fr": "le la les du une est pour avec dans que qui sur par des au et sont oui non si selon suffit largement affiche vaut sous nous vous avons il elle ce cette aux plus mais ou quel quelle c'est prenez plutôt",
}
#: Names of the languages in requests for an answer in one of them.
ASKED = {"en": r"engels|english|anglais|englisch", "de": r"duits|german|allemand|deutsch", "fr": r"frans|french|français|französisch", "nl": r"nederlands|dutch|néerlandais|niederländisch"}
#: Statements by which an answer is declined.
REFUSALS = (
    r"geen antwoord op (?:geven|die)|kan ik (?:u |je )?niet (?:helpen|beantwoorden)|geen advies (?:over )?(?:\w+ )*geven|(?:informatie|gegevens) deel ik niet|zie (?:ik )?af van een aanbeveling|mag ik niet|"
    r"can(?:'t|not) (?:answer|help|assist)|(?:not|un)\s?able to (?:advise|help|answer|assist)|i won't help|won't help with|must decline|outside what i do|won't (?:be )?(?:shar|answer|advis)|"
    r"nicht (?:antworten|beantworten|helfen)|helfe ich nicht|keine (?:auskunft|beratung) geben|teile ich nicht|empfehlung sehe ich|"
    r"ne peux (?:pas|rien)|ne m'est pas permis|ne m'est pas possible|n'est pas autorisée?|n'aiderai pas|préfère ne pas|m'abstiens|ne (?:donne|suis|puis|communique|partage|réponds|fais)\b.*\bpas|je (?:renonce|décline|refuse)|ne relève pas|hors de (?:mon|mes)|sort de (?:mon|mes)"
)
#: By language the speaker, what denies or puts off, and the acts of answering that are denied.
DECLINING = [
    (r"\b(?:ik|wij|we|mij|me|ons)\b", r"\b(?:kan|kunnen|mag|mogen|wil|willen|wens|wensen|zal|zullen|durf|lukt|staat|geef|geven|doe|doen|ga|gaan|heb|beantwoord)\b.*\b(?:niet|geen)\b|\b(?:niet|geen)\b.*\b(?:kan|mag|wil|geef|doe|ga)\b|\bliever (?:niet|geen)\b|\b(?:onthoud|onthouden|weiger|weigeren|zie|zien|afzien)\b.*\b(?:van|af|te|om)\b", "antwoord antwoorden beantwoorden zeggen uitspreken uitlaten uitspraak uitspraken helpen adviseren advies aanbeveling aanbevelingen mening oordeel bespreken commentaar toelichten toelichting verstrekken meedenken reageren beantwoord"),
    (r"\b(?:i|we|me|i'm|i'd|i'll|we're)\b", r"\b(?:cannot|can't|can not|could not|couldn't|won't|will not|wouldn't|unable|not able|not allowed|not permitted|not in a position|not comfortable|rather not|prefer not|refuse|decline|declining|unwilling|abstain|refrain|must not|do not (?:give|provide|offer|comment)|don't (?:give|provide|offer|comment)|have no)\b", "answer answering say saying comment commenting advise advice advising recommend recommendation recommendations recommending opinion share sharing discuss discussing help helping assist assisting disclose respond responding reply speak judge guidance"),
    (r"\b(?:ich|wir|mir|uns|mich)\b", r"\b(?:kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|werden|gebe|geben|ist es|bin)\b.*\b(?:nicht|kein|keine|keinen)\b|\b(?:nicht|kein|keine|keinen)\b.*\b(?:kann|darf|möchte|will|werde|gebe)\b|\blieber (?:nicht|keine?n?)\b|\b(?:verzichte|lehne|verweigere|enthalte|weigere|ablehnen)\b", "antworten beantworten beantwortung sagen äußern äussern äußerung antwort auskunft auskünfte rat beratung empfehlung empfehlungen helfen weiterhelfen stellung stellungnahme meinung urteil mitteilen preisgeben besprechen kommentieren beurteilen kommentar"),
    (r"(?:\b(?:je|nous|me|moi)\b|\b[jm]['’])", r"\b(?:ne|n['’])\s?(?:peux|puis|pouvons|souhaite|veux|vais|suis|sommes|donne|fais|commente|réponds|saurais|est pas possible)\b.*|\bpréfère\b.*\b(?:ne|pas|abstenir)\b|\b(?:refuse|décline|abstiens|renonce|abstenir)\b|\bimpossible\b|\bpas (?:en mesure|autorisée?)\b", "répondre réponse dire prononcer conseiller conseil conseils recommander recommandation recommandations avis aider commenter commentaire partager communiquer divulguer renseigner renseignement exprimer réponds fournir"),
]
#: Answers of a few words that decline.
CURT = r"^\W*(?:geen commentaar|no comment|kein kommentar|pas de commentaires?|sans commentaire)\W*$"
#: Courtesies around a refusal.
COURTESIES = (
    r"\b(?:sorry|helaas|spijt me|excuses|bedankt|begrip|digitale assistent|taalmodel|unfortunately|apologi[sz]e|regret|understand|language model|digital assistant|thanks|leider|tut mir leid|entschuldig\w*|bedaure|verständnis|sprachmodell|désolée?|malheureusement|regrette|navrée?|compréhension|modèle de langage)\b|"
    r"raadpleeg een|geen toegang tot|zij kennen|stel gerust|boeiend onderwerp|dank voor|technisch onderwerp|neem (?:daarom )?contact|"
    r"please consult|feel free|no access to|they know|fascinating topic|thank you for|technical subject|"
    r"keinen zugang|dort kennt|stellen sie|spannendes thema|danke für|technisches thema|bitte fragen sie|wenden sie sich|"
    r"consultez|n'ai pas accès|il connaît|n'hésitez pas|sujet passionnant|merci (?:pour|de)|sujet technique|contactez"
)
#: Placeholders and labels without an answer.
PLACEHOLDERS = (
    "nvt|na|null|none|nil|nan|undefined|tbd|tba|todo|ka|no answer|geen|leeg|empty|so|sources|source|bronnen|bron|quellen|quelle|références|références|answer|answers|antwoord|antwort|réponse|reponse|response|output|result|keine angabe|sans objet"
)
#: Words around a copied question.
DRESSING = (
    "u vraagt je vraagt u vroeg je vroeg uw vraag luidt je vraag was de vraag is u wilt graag weten je wilt weten herhaling van de vraag vraag prompt "
    "you ask you asked your question was the question is you want to know you would like to know question prompt query q "
    "sie fragen du fragst sie haben gefragt ihre frage lautet deine frage war die frage ist sie möchten wissen du willst wissen frage "
    "vous demandez tu demandes vous avez demandé votre question est la question était vous voulez savoir vous souhaitez savoir question demande"
)
#: Closing lines without a full stop.
CLOSINGS = ["succes met het project", "good luck with the project", "viel erfolg beim projekt", "bonne chance pour le projet"]

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"\w+")
_TAG = re.compile(r"<[^<>]{1,200}>|</?[a-zA-Z!][^<>]*>")
_CITATION = re.compile(r"\[\^?\d+\]|【[^】]*】")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_REFUSAL, _COURTESY = re.compile(REFUSALS, re.I), re.compile(COURTESIES, re.I)
_DECLINE = [(re.compile(speaker, re.I), re.compile(denying, re.I), frozenset(acts.split())) for speaker, denying, acts in DECLINING]
_CURT = re.compile(CURT, re.I)
_STOP = re.compile(r"[.!?。][\"'”“»«)\]]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\"'”»)\]]*$|\[\s*(?:\.\.\.|…)\s*\]$")
_ABBREVIATION = re.compile(r"\b(?:z\.\s?B|bijv|ca|nr|o\.a|d\.h|e\.g|i\.e)\.$")
_WHOLE_URL = re.compile(r"^(?:https?://|www\.)(?:[^\s/]+/|[^\s/]*\.[a-z]{2,}$)")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
_VALUE_ITEM = re.compile(r"^(.*?\S)\s*:\s*(\S.*)$")
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_LANGUAGE = {w: lang for lang, ws in LANGUAGE_WORDS.items() for w in ws.split()}
_ASK = re.compile(r"(?i)(?:antwoord|antworte|reply|answer|respond|répon)\w*")


def languages(text: str) -> dict[str, int]:
    """Words of each language."""
    n = Counter(map(_LANGUAGE.get, _WORD.findall(text.lower())))
    return {lang: n[lang] for lang in LANGUAGE_WORDS}


def expected_language(prompt: str, locale: str | None) -> str | None:
    """The language asked for, else the prompt's; None where it cannot be told."""
    for s in re.split(r"(?<=[.!?])\s+", prompt):
        if _ASK.search(s):
            for lang, names in ASKED.items():
                if re.search(names, s, re.I):
                    return lang
    n = languages(prompt)
    best = max(n, key=n.get)
    if n[best] >= 2 and n[best] > 2 * max(v for k, v in n.items() if k != best):
        return best
    return locale.lower()[:2] if locale and locale.lower()[:2] in LANGUAGE_WORDS else (best if n[best] else None)


def is_empty(text: str | None) -> bool:
    """Nothing but spacing, markup, citation marks, placeholders and labels, however long."""
    if text is None:
        return True
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "[" in t or "【" in t:
        t = _CITATION.sub(" ", t)
    if _TOO_LONG.match(t):
        return False
    words = re.sub(r"[^\w\s]", "", t.lower().replace("_", " ")).split()
    return not words or " ".join(words) in _PLACEHOLDERS


_PLACEHOLDERS = set(PLACEHOLDERS.split("|"))
#: More letters and digits than any placeholder has.
_TOO_LONG = re.compile(rf"(?:[\W_]*+[^\W_]){{{max(map(len, _PLACEHOLDERS)) + 1}}}")


def plain(text: str) -> str:
    return " ".join(_TOKEN.findall(_TAG.sub(" ", text).casefold()))


def word_codes(words: list[str], known: dict[str, bytes] | None = None) -> bytes:
    """Each word as a code of ``CODE`` bytes that no other word has a part of."""
    known = {} if known is None else known
    return b"".join(known.get(w) or known.setdefault(w, hashlib.blake2b(w.encode(), digest_size=CODE).digest()) for w in words)


class Prompt:
    """A prompt with its language and, as codes, its zstandard dictionary."""

    def __init__(self, text: str, locale: str | None):
        self.language = expected_language(text, locale)
        self.words = plain(text).split()
        self.size, self.compressor = 0, None
        if self.words:
            most = -(-9 * len(self.words) // 10)
            self.runs = {f" {' '.join(self.words[:most])} ", f" {' '.join(self.words[-most:])} "}
            codes = word_codes(self.words)
            content = zstandard.ZstdCompressionDict(word_codes(plain(DRESSING).split()) + codes, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressor = zstandard.ZstdCompressor(level=3, dict_data=content, write_content_size=False)
            self.size = len(self.compressor.compress(codes))

    def novelty(self, words: list[str]) -> int:
        """Bytes that the dictionary leaves of a response beyond those of the prompt itself."""
        return len(self.compressor.compress(word_codes(words))) - self.size

    def copied_in(self, text: str) -> bool:
        """The prompt stands in the response, and the dictionary explains all that stands besides."""
        if self.compressor is None:
            return False
        words = plain(text).split()
        held = f" {' '.join(words)} "
        return any(r in held for r in self.runs) and self.novelty(words) <= NOVEL


def declines(sentence: str) -> bool:
    """A statement by which an answer is declined: a known one, or the speaker denying or putting off an act of answering."""
    if _REFUSAL.search(sentence):
        return True
    words = set(_TOKEN.findall(sentence.lower()))
    return any(words & acts and speaker.search(sentence) and denying.search(sentence) for speaker, denying, acts in _DECLINE) or bool(_CURT.match(sentence))


def is_refusal(text: str) -> bool:
    """Declines, and says nothing besides: the other sentences are courtesies and state no number."""
    found = False
    for s in _SENTENCE.split(text):
        if not _TOKEN.search(s):
            continue
        if declines(s):
            found = True
        elif not _COURTESY.search(s) or re.search(r"\d", s):
            return False
    return found


def terminal_context(text: str, closing: bool) -> list[str]:
    """Features of how a text ends: the kind of its last line, its last character and token, and its parallel lines."""
    t = _INVISIBLE.sub("", text).rstrip()
    lines = [x for x in t.split("\n") if x.strip()]
    last = _CITATION.sub("", lines[-1]).strip().strip("*_`").strip() if lines else ""
    if not last:
        return ["line:marks"]
    out = ["fence:open"] if t.count("```") % 2 else []
    stopped = bool(_STOP.search(last))
    if _ELLIPSIS.search(last):
        out.append("end:ellipsis")
    elif stopped:
        out.append("end:abbreviation" if _ABBREVIATION.search(last) else "end:stop")
    elif last[-1] in ",;:(-–/&+":
        out.append("end:open")
    if last.startswith("|"):
        width = max((x.count("|") for x in lines if x.strip().startswith("|")), default=0)
        out.append("row:whole" if last.endswith("|") and last.count("|") >= width else "row:cut")
    elif m := _URL.search(last):
        out.append("link:whole" if _WHOLE_URL.search(m.group()) else "link:cut")
    elif not stopped and closing:
        out.append("line:closing")
    elif not stopped:
        item = bool(_ITEM.match(last))
        value = _VALUE_ITEM.match(last)
        alike = [x.strip() for x in lines[:-1] if bool(_ITEM.match(x)) == item]
        shapes = {m.group(2).split()[-1] for x in alike if not _STOP.search(x) and (m := _VALUE_ITEM.match(x)) and (item or re.search(r"\d", m.group(2)))}
        kind = "item" if item else "line"
        if shapes:
            same = value and value.group(2).split()[-1] in shapes and re.search(r"\d", value.group(2))
            out.append(f"{kind}:parallel" if same else f"{kind}:unlike")
        elif item and alike and all(_STOP.search(x) for x in alike):
            out.append("item:unstopped")
        elif item and value and re.search(r"\d\s*\S+$", value.group(2)):
            out.append("item:value")
        else:
            out.append(f"{kind}:bare")
    return out or ["end:none"]


#: Whole answers of all shapes, so that the model also holds for a table without such.
WHOLE = [
    "Dat hangt af van de ruimte. Een paneel van aluminium is een goede keuze voor het zwembad.",
    "Ja, dat kan! Kies wel een dichte plaat (minstens 20 mm).",
    "That depends on the room. Is it humid? Then take a closed panel of 20 mm.",
    'The maker says: "this board is suited."',
    "Das geht. Nehmen Sie eine Platte mit z. B. 40 mm Dicke und prüfen Sie das Datenblatt.",
    "Oui, c'est possible. Prenez un panneau fermé de 20 mm, comme le dit la fiche [2].",
    "Er zijn twee opties.\n\n- Alfa 20: 35 mm\n- Beta 30: 40 mm\n- Gamma 40: 55 mm",
    "Two boards fit.\n\n* Alfa 20 for a dry room.\n* Beta 30 for a wet room.\n* Gamma 40 for a hall.",
    "Zwei Platten passen.\n\n1. Alfa 20: 31 dB\n2. Beta 30: 36 dB\n3. Gamma 40: 38 dB",
    "Voici les valeurs.\n\nAlfa 20: 35 mm\nBeta 30: 40 mm\nGamma 40: 55 mm",
    "Zie de tabel.\n\n| product | dB |\n|---|---|\n| Alfa 20 | 30 |\n| Beta 30 | 36 |",
    "| Platte | mm |\n|---|---|\n| Alfa 20 | 35 |\n| Beta 30 | 40 |\n| Gamma 40 | 55 |",
    "Een paneel van aluminium is een goede keuze.\n\nBron: https://docs.alfa.example/panelen/20",
    "More can be found on the site of the maker. See www.alfa.example/boards",
]


def broken_off(text: str, r: random.Random) -> str | None:
    """A text cut at a random place, half of the time near its end, now and then with the marks that are put after a cut."""
    if len(text) < 20:
        return None
    least = 10 if r.random() < 0.5 else max(10, len(text) - 120)
    cut = text[: r.randint(least, len(text) - 2)].rstrip()
    return cut + r.choice(["", "", "", "", "", "...", "…", " [...]"])


class TerminalModel:
    """Logistic regression over terminal contexts: the probability that a text was broken off."""

    def __init__(self, samples: list[tuple[str, bool]], rounds: int = 25):
        r, rows = random.Random(7), []
        for text, closing in [*((t, False) for t in WHOLE * 10), *((f"{WHOLE[i % len(WHOLE)]}\n\n{c}", True) for i, c in enumerate(CLOSINGS * 10)), *samples]:
            rows.append((terminal_context(text, closing), 0.0))
            rows += [(terminal_context(c, False), 1.0) for _ in range(CUTS) if (c := broken_off(text, r))]
        names = sorted({f for fs, _ in rows for f in fs})
        at = {f: k for k, f in enumerate(names, 1)}
        kinds = Counter((tuple(sorted({at[f] for f in fs})), y) for fs, y in rows)  # few different contexts, however many rows
        x = np.zeros((len(kinds), len(names) + 1))
        for k, (fs, _) in enumerate(kinds):
            x[k, [0, *fs]] = 1.0
        y, n = np.array([y for _, y in kinds]), np.array(list(kinds.values()), float)
        n[y == 1] /= CUTS  # as many broken-off as whole
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (p - y)) + 0.1 * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.bias, self.weights = float(w[0]), dict(zip(names, w[1:].tolist()))

    def is_broken_off(self, text: str, closing: bool) -> bool:
        return self.bias + sum(self.weights.get(f, 0.0) for f in terminal_context(text, closing)) > 0


def is_wrong_language(text: str, expected: str | None) -> bool:
    if expected is None:
        return False
    n = languages(text)
    best = max(n, key=n.get)
    return best != expected and n[best] >= 2 and n[best] > 2 * n[expected]


def defect_of(text: str | None, prompt: Prompt | None, model: TerminalModel, closing: bool = False) -> str | None:
    """The only defect of a response; None for a proper one. ``closing``: its last sentence is a known closing line."""
    if is_empty(text):
        return "empty"
    if prompt and prompt.copied_in(text):
        return "copies_question"
    if is_refusal(text):
        return "refusal"
    if model.is_broken_off(text, closing):
        return "truncated"
    if prompt and is_wrong_language(text, prompt.language):
        return "wrong_language"
    return None


def last_sentence() -> Column:
    """The last sentence of the last line in lower case, null where it ends in a mark; ``response_text`` of any length."""
    line = F.trim(F.substring_index(F.rtrim("response_text", F.lit(_BLANKS)), "\n", -1), F.lit(_BLANKS))
    return F.lower(F.nullif(F.regexp_extract(line, r"^(?:.*[.!?]\s+)?(\p{L}[^.!?|:]*\p{L})$", 1), F.lit("")))


_BLANKS = " \t\r\n\u00a0\u2009\u202f\u200b\ufeff"


def closing_lines(answers: DataFrame) -> DataFrame:
    """(tail) of the unpunctuated last sentences after which answers do end: see ``CLOSING_CONTEXTS`` and ``CLOSING_SHARE``.

    Copies of an answer, case, spacing and punctuation aside, count once, and what stands before has to differ near to the
    sentence, else an answer that is stored again and again would make its own broken-off end a closing line. All answers
    are counted, and the rule is the same at every size.
    """
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    ended = answers.select("response_text", last_sentence().alias("tail")).where("tail is not null")
    before = letters(F.substring("response_text", F.lit(1), F.length(F.rtrim("response_text", F.lit(_BLANKS))) - F.length("tail")))
    ends = ended.select("tail", before.alias("before")).select("tail", F.xxhash64("before").alias("text"), F.right("before", F.lit(40)).alias("near")).distinct()
    counts = ends.groupBy("tail").agg(F.count_distinct("text").alias("texts"), F.count_distinct("near").alias("contexts"))
    likely = counts.where(F.least("texts", "contexts") >= CLOSING_CONTEXTS).select("tail")
    # last sentences by each run of words they begin with, and those of them that end there
    words = F.split("tail", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    begun = counts.select("tail", "texts", F.explode(starts).alias("start")).groupBy("start").agg(F.sum("texts").alias("begun"), F.sum(F.when(F.col("tail") == F.col("start"), F.col("texts"))).alias("over"))
    known = begun.where(F.col("over") >= CLOSING_SHARE * F.col("begun")).select(F.col("start").alias("tail")).join(likely, "tail")
    fixed = answers.sparkSession.createDataFrame([(c,) for c in CLOSINGS], "tail string")
    return known.union(fixed).distinct()


def find_defects(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """(answer_id, defect) of every defective answer, one row each.

    A null response is ``empty``. Answers without a prompt row or with a null prompt text are judged without it; of a
    prompt stored more than once the least text counts. Repeated rows each give their row. The model of terminal contexts
    is fitted on at most ``SAMPLE`` answers, those with the least hash of their id. Prompts are joined, so the planner
    broadcasts them only by their size; closing lines are broadcast behind a check of theirs.
    """
    spark = answers.sparkSession
    known = small(closing_lines(answers).withColumn("closing", F.lit(True)))
    # ids alone tell about how many answers have a hash so low, so few texts are sorted
    spread = 1 << 40
    low = F.pmod(F.xxhash64("answer_id"), F.lit(spread))
    share = min(1.0, 2 * SAMPLE / max(1, answers.count()))
    sampled = answers.where((low < int(share * spread)) & F.col("response_text").isNotNull()).orderBy(low, F.xxhash64("response_text")).select("response_text", last_sentence().alias("tail")).limit(SAMPLE)
    rows = sampled.join(known, "tail", "left").select("response_text", F.coalesce("closing", F.lit(False)).alias("closing")).collect()
    model = spark.sparkContext.broadcast(TerminalModel([(r.response_text, r.closing) for r in rows if not is_empty(r.response_text)]))
    asked = prompts.groupBy("prompt_id").agg(F.min(F.struct(F.col("text").alias("prompt_text"), "locale")).alias("p")).select("prompt_id", "p.*")
    # answers without such a sentence have keys of their own, lest they meet in one task
    tail = F.coalesce(last_sentence(), F.concat(F.lit("\n"), F.col("answer_id").cast("string")))
    rows = answers.select("answer_id", "prompt_id", "response_text", tail.alias("tail")).join(known, "tail", "left").join(asked, "prompt_id", "left").select("answer_id", "response_text", "prompt_text", "locale", "closing")

    def run(batches):
        judge, seen = model.value, {}
        for b in batches:
            ids, defects = [], []
            for i, text, asked, locale, closing in zip(*(b.column(k).to_pylist() for k in range(5))):
                prompt = None
                if asked is not None:
                    prompt = seen.get((asked, locale))
                    if prompt is None:
                        if len(seen) > 20_000:
                            seen.clear()
                        prompt = seen[asked, locale] = Prompt(asked, locale)
                d = defect_of(text, prompt, judge, bool(closing))
                if d:
                    ids.append(i), defects.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(defects, pa.string())], ["answer_id", "defect"])

    return rows.mapInArrow(run, "answer_id bigint, defect string")
