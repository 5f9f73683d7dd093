"""Keyword-stuffed and link-list pages.

A page is cut into sentences and lines. Those with clause structure are prose: function words of the four languages among
the others, or in any language many different short words between the longer ones. Of the rest, links with their anchors,
tags and priced names count at once; the other words go into the page's suffix automaton. A line counts as keywords whole
where its share covered by repeated maximal substrings and its missing structure together reach ``KEYWORDS``, else with the
words covered. A page is spam if more than half of all its words count.

The automaton is built over word numbers instead of characters, and coverage is measured in words, because the result is
a share of words. Pages whose prose alone holds half of the words cannot be spam, so no automaton is built for them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: A page is spam above this share of keyword, link and list words.
SHARE = 0.5
#: Least share of function words of a clause, and least number of different ones.
CLAUSE_SHARE, CLAUSE_WORDS = 0.18, 2
#: In any language: letters of a short word, least share of short words of a clause, least number of different ones, of words.
SHORT, SHORT_SHARE, SHORT_KINDS, SHORT_CLAUSE = 3, 0.22, 3, 6
#: Coverage plus missing structure from which a line counts whole; the structure that an enumeration of at least so many
#: items and a line of at least so many words without a clause lack.
KEYWORDS, ITEMS, LONG = 0.5, 5, 12
LIST_LACKS, LINE_LACKS = 0.5, 0.25
#: Words of a phrase: short words bind a line to prose only if less than ``KEYWORDS`` of it are phrases that recur.
PHRASE = 3

#: Function words by language.
FUNCTION_WORDS = (
    "de het een van heeft voor met wordt worden zijn is niet op aan ook maar te zonder uit bij naar deze die dat dit geen kan na tot als dan om daarom waarna hoewel zodat zolang wie let eerst en pas daarna elke moet anders sinds onder boven blijft blijven tussen want zit vooral soms minder weinig zeggen kreeg hoorde legde er wij zagen hetzelfde was waar "
    "the of and has with that for from which was were are this it its be at a an to can as by on in though even after although when so below above while because but not than who should yet such say little many once still between since where before any all we saw one more less there their them they he she his her please note "
    "der die das den dem des und ist nicht von zu zum zur ein eine einen einem einer hat wird werden wurde auf bei aus im wenn sich als wer wonach obwohl dass doch denn damit warum nach laut bis über unter zwischen nur noch auch kann man wir ihm solche sagen wenig viele sowie sonst lässt alles alle deshalb erst danach steht gibt zeigte erhielt legte hörte mit für diese dieser dieses seit zwei ohne wo länger wirkt wünschte "
    "le la les du une un des est sont pour avec dans que qui sur par au aux et l d qu s n c ce cette ces si bien mais car ou où puis sous plus moins après avant selon comme sans tant depuis entre pourquoi reste disent peu ont été être se son sa ses leur leurs lui il elle nous vous on ne pas y en dont souvent doit sinon même "
)
#: Function words that also join keywords; alone they make no clause.
_WEAK = frozenset("in en ook a on de of y et und and pour für voor for".split())
_FUNCTION = frozenset(FUNCTION_WORDS.split()) - _WEAK

#: Short words that are units.
_UNITS = frozenset("mm cm dm m km in ft kg g t db hz khz pa kpa mpa kn n w kw kwh mk m2 m3 l s min h eur usd gbp pct px".split())

_BINDING = _FUNCTION | _WEAK
_WORD = re.compile(r"[^\W_]+")
_HTML_LINK = re.compile(r"<a\b[^<>]*>(?:(?!<a\b).)*?</a>", re.S | re.I)
_MARKDOWN_LINK = re.compile(r"\[[^\[\]\n]*\]\([^()\s]{3,}\)")
_SHORT = re.compile(rf"(?<![\w'’-])[^\W\d_]{{1,{SHORT}}}(?![\w-])(?!\s*\d)")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"<[^<>]+>")
_HASH = re.compile(r"#[^\W\d][\w-]*")
_PRICE = re.compile(r"(?:[€$£]\s?\d|\d\s?(?:€|eur\b|euro\b))", re.I)
_VALUE = re.compile(r"^[-*•]?\s*[^\d:][^:]{0,60}:\s*[<>≤≥~±]?\s*[\d.,/]+(?:\s*[-–]\s*[\d.,/]+)?\s*\S{0,14}(?:\s\S{1,10})?$")
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+")
_LABEL = re.compile(r"^\s*(?:tags?|keywords?|trefwoorden|zoekwoorden|schlagwörter|schlagworte|suchbegriffe|mots[- ]clés|étiquettes|labels?|etiquetas|palabras clave|etichette|parole chiave|palavras-chave)\s*:", re.I)


def is_clause(words: list[str]) -> bool:
    """Function words bind the others together."""
    if len(words) < 4:
        return False
    bound = [w for w in words if w in _BINDING]
    if len(bound) < CLAUSE_SHARE * len(words):
        return False
    kinds = set(bound)
    strong = len(kinds - _WEAK)
    return strong >= CLAUSE_WORDS or strong >= 1 and len(kinds) > CLAUSE_WORDS


def is_bound(sentence: str, n: int) -> bool:
    """Short words of many kinds stand among the others, as in the prose of any language; codes and units are none."""
    if n < SHORT_CLAUSE:
        return False
    short = [w for w in _SHORT.findall(sentence) if w.islower() and w not in _UNITS]
    return len(short) >= SHORT_SHARE * n and len(set(short)) >= SHORT_KINDS


def repeated_cover(words: list[int], least: int = 1) -> bytearray:
    """For each position whether a repeated maximal substring of the sequence, of ``least`` words or more, covers it.

    A suffix automaton with occurrence counts; every state that occurs twice or more marks the positions at which its
    longest substring ends, and marks spread back over its length.
    """
    nxt, link, length, count = [{}], [-1], [0], [0]
    state_at, last = [], 0
    for w in words:
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1), count.append(1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy()), link.append(link[q]), length.append(length[p] + 1), count.append(0)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        state_at.append(cur)
        last = cur
    for s in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
        count[link[s]] += count[s]
    longest = [0] * len(nxt)  # of the longest repeated suffix
    for s in sorted(range(1, len(nxt)), key=length.__getitem__):
        longest[s] = length[s] if count[s] >= 2 else longest[link[s]]
    longest = [n if n >= least else 0 for n in longest]
    covered, reach = bytearray(len(words)), len(words)
    for i in range(len(words) - 1, -1, -1):
        reach = min(reach, i + 1 - longest[state_at[i]])
        covered[i] = reach <= i
    return covered


def keyword_share(text: str) -> float:
    """Share of a page's words that are keywords, links or enumerations; 0 for a page without words."""
    links = 0

    def linked(m: re.Match) -> str:
        nonlocal links
        links += len(_WORD.findall(_TAG.sub(" ", m.group()))) + (len(_WORD.findall(m.group())) if m.group()[:2].lower() == "<a" else 0) // 2
        return " "

    rest = text
    if "<" in rest:
        rest = _TAG.sub(" ", _HTML_LINK.sub(linked, rest))
    if "](" in rest:
        rest = _MARKDOWN_LINK.sub(linked, rest)
    if "://" in rest or "www." in rest:
        rest = _URL.sub(linked, rest)
    prose, certain, loose, neutral, listed, bound = 0, links, [], 0, [], 0
    for s in _SPLIT.split(rest):
        words = _WORD.findall(s.lower())
        if not words:
            continue
        n = len(words)
        if "#" in s and len(tags := _HASH.findall(s)) >= 2:
            certain += n
        elif _LABEL.match(s) or _PRICE.search(s) and not is_clause(words):
            certain += n
        elif is_clause(words):
            prose += n
        elif _VALUE.match(s):
            neutral += n
        else:
            items = s.count(",") + s.count(";") + s.count(" | ")
            held = is_bound(s, n)
            listed.append((len(loose), n, items, held))
            loose += words
            bound += n if held else 0
    total = prose + certain + neutral + len(loose)
    if not total:
        return 0.0
    if prose + neutral >= (1 - SHARE) * total:
        return certain / total
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in loose]
    covered = repeated_cover(ids)
    phrases = repeated_cover(ids, PHRASE) if bound else covered
    for start, n, items, held in listed:
        if held and sum(phrases[start : start + n]) < KEYWORDS * n:
            continue  # prose, as its words recur but its phrases do not
        cover = sum(covered[start : start + n])
        lacks = LIST_LACKS if items >= ITEMS else LINE_LACKS if n >= LONG else 0.0
        certain += n if lacks and cover / n + lacks >= KEYWORDS else cover
    return certain / total


def find_spam(documents: DataFrame) -> DataFrame:
    """(doc_id) of every page more than half of whose words are keywords, links with anchors, tags or priced names.

    Null and empty texts and texts without words are no spam. Repeated rows each give their row. One narrow map over whole
    texts: no shuffle, and memory grows with the longest single page only.
    """

    def run(batches):
        for b in batches:
            ids = [i for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and keyword_share(t) > SHARE]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint")
