"""Mapping of freely entered values to a canonical list.

A multi-pattern automaton over the names and aliases of the list finds the mentions embedded in an entered value; the
longest non-overlapping match wins. What is left over goes to token-set similarity (of character pairs), looked up by
shared one-deletion forms. Values that mean no entry are reported as ``unmatched``.

The list is broadcast in slices of at most ``LIST_BOUND`` entries, one at a time: a longer list is passed over the distinct
entered values slice by slice, what each slice finds is stored and its broadcast removed before the next, so it costs more
passes, never more memory.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citebase.operators.vocabulary import SPEC_ALIASES
from citebase.session import checkpointed

#: Entries of the list that one broadcast may hold: about 120 MB in each worker.
LIST_BOUND = 50_000
#: Values resolved once that a worker remembers.
CACHE = 200_000
#: Least similarity of a mistyped name.
SIMILAR = 0.55
#: Least similarity of what one edit does not explain: a series beside its qualifier, number and brand, and a spec key.
SIMILAR_SERIES, SIMILAR_SPEC = 0.6, 0.8

#: Other words for the qualifiers of product names.
QUALIFIER_ALIASES: dict[str, list[str]] = {
    "acoustic": ["akustik", "acoustique", "akoestisch", "akoestiek", "akustisch"],
    "aqua": ["wasser", "water", "eau"],
    "baffle": ["baffel", "baffles"],
    "design": [],
    "fire": ["feuer", "brand", "feu", "vuur"],
    "hygiene": ["hygienisch", "hygienique"],
    "lamella": ["lamelle", "lamellen", "lamelles"],
    "mono": [],
    "secure": ["sicher", "veilig", "securise"],
    "thermo": ["thermisch", "thermique", "thermic"],
}
#: Words around a product name that say nothing about it.
GENERIC = (
    "ceiling panel|ceiling tile|dalle|dalle de plafond|deckenplatte|paneel|panel|panneau|plafond|plafondpaneel|plafondplaat|systeemplafond|tegel|tile|group|ceilings"
).split("|")
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝһӏνοαικτρυ", "aeopcyxijsdqwhlvoaiktpy")

_MARKS = re.compile(r"\(\s*(?:tm|r|c)\s*\)|[®™©℠]")
_SIZE = re.compile(r"\d{2,4}\s*[x×*]\s*\d{2,4}(?:\s*mm)?")
_COUNTER = re.compile(r"(?:type|typ|nr\.?|n[°º]\.?)\s*(?=\d)")
_NUMBER = re.compile(r"(?<!\d)\d[\do]*")
_SEPARATORS = re.compile(r"[\W_]+")
_LETTERS = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    """Lower case, no accents, no invisible characters, look-alike letters made Latin, trade marks dropped."""
    t = _MARKS.sub(" ", text)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.lower().translate(LOOKALIKES))
        t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").replace("ß", "ss")
    return t.lower()


def deletion_forms(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def pair_similarity(a: str, b: str) -> float:
    """Dice coefficient of the sets of neighbouring characters."""
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} for w in (f" {a} ", f" {b} "))
    return 2 * len(x & y) / (len(x) + len(y))


def _pair_set(text: str) -> set[str]:
    """Neighbouring characters of the words of a text, whatever the order of the words."""
    return {w[i : i + 2] for word in text.split() for w in (f" {word} ",) for i in range(len(w) - 1)}


class PairIndex:
    """Names by their character pairs, for the most similar one by Dice coefficient."""

    def __init__(self, names: dict[str, str]):
        self.sets = {n: _pair_set(n) for n in names}
        self.values = names
        self.holding = defaultdict(list)
        for n, pairs in self.sets.items():
            for x in pairs:
                self.holding[x].append(n)

    def nearest(self, text: str, least: float) -> tuple[float, set[str]]:
        """The highest similarity from ``least`` on and the values of all names that have it.

        A name so similar shares so many pairs that it holds one of the rarest ones (prefix filter).
        """
        pairs = _pair_set(text)
        shared = math.ceil(least * len(pairs) / (2 - least) - 1e-9)
        rare = sorted(pairs, key=lambda x: (len(self.holding.get(x, ())), x))[: len(pairs) - shared + 1]
        best, found = least, set()
        for n in {n for x in rare for n in self.holding.get(x, ())}:
            score = 2 * len(pairs & self.sets[n]) / (len(pairs) + len(self.sets[n]))
            if score > best:
                best, found = score, set()
            if score >= best:
                found.add(self.values[n])
        return (best, found) if found else (0.0, found)


def _one_edit(a: str, b: str) -> bool:
    """A shared deletion form is known; what is left to exclude are two different deletions far apart."""
    return abs(len(a) - len(b)) == 1 or len(a) == len(b) and (sum(p != q for p, q in zip(a, b)) <= 1 or sorted(a) == sorted(b))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class ProductList:
    """Products by series, qualifier and number, and the automaton over everything a name is made of."""

    def __init__(self, products: list[tuple[str, str, str]]):
        self.exact = {name for _, _, name in products}
        self.by_key, self.forms, self.brands = defaultdict(list), defaultdict(set), {}
        series, qualifiers, brands = set(), set(), set()
        for product_id, brand, name in products:
            brand = fold(brand or "").strip()
            parts = _SEPARATORS.sub(" ", fold(name)).split()
            if len(parts) < 2:
                parts = [*parts, ""]
            number = parts.pop() if parts[-1].isdigit() else ""
            head, rest = parts[0], " ".join(parts[1:])
            series.add(head), qualifiers.add(rest), brands.add(brand)
            self.by_key[head, rest].append((number, brand, product_id))
        self.brand_names = brands - {""}
        kinds: dict[str, tuple[str, str]] = {}
        prefixes = defaultdict(set)
        for q in qualifiers - {""}:
            for form in (q, *QUALIFIER_ALIASES.get(q, ())):
                kinds[form] = ("q", q)
                for n in range(3, len(form)):
                    prefixes[form[:n]].add(q)
        for p, of in prefixes.items():
            if len(of) == 1 and p not in kinds:
                kinds[p] = ("a", *of)
        self.qualifiers = {form: of[1] for form, of in kinds.items()}
        self.qualifier_forms = defaultdict(set)
        for q in qualifiers - {""}:
            for f in deletion_forms(q):
                self.qualifier_forms[f].add(q)
        for g in GENERIC:
            kinds.setdefault(g, ("g", g))
        for b in self.brand_names:
            kinds[b] = ("b", b)
        for s in series:
            kinds[s] = ("s", s)
            for f in deletion_forms(s):
                self.forms[f].add(s)
        self.similar = PairIndex({s: s for s in series})
        self.automaton = ahocorasick.Automaton()
        for text, kind in kinds.items():
            self.automaton.add_word(text, (len(text), *kind))
        self.automaton.make_automaton()

    def _near(self, run: str) -> set[str]:
        """Series that differ from a run of letters by one edit and share most character pairs with it."""
        return {s for f in deletion_forms(run) for s in self.forms.get(f, ()) if _one_edit(run, s) and pair_similarity(run, s) >= SIMILAR}

    def parse(self, name: str) -> tuple[list[str], str | None, str | None, str | None, float]:
        """Possible series, qualifier, number and brand of an entered name, and how similar the series are (1: found)."""
        t = _COUNTER.sub(" ", _SIZE.sub(" ", fold(name)))
        number = next((m.group().replace("o", "0") for m in _NUMBER.finditer(t)), None)
        t = _SEPARATORS.sub(" ", _NUMBER.sub(" ", t))
        series, qualifier, brand, covered, last, score = [], None, None, bytearray(len(t)), 0, 1.0
        hits = [(end + 1 - size, end + 1, size, kind, value) for end, (size, kind, value) in self.automaton.iter_long(t)]
        starts = {h[0] for h in hits if h[3] == "s"}
        for start, end, size, kind, value in hits:
            left = start == 0 or start == last or not t[start - 1].isalpha()
            right = end == len(t) or not t[end].isalpha() or end in starts
            if kind == "s" or kind == "b" and (left or right):
                pass
            elif kind == "q" and right and (left or size >= 4):
                pass
            elif kind in "agq" and left and right:
                pass
            else:
                continue
            if kind == "s":
                series.append(value)
            elif kind == "b":
                brand = value
            elif kind in "qa" and qualifier is None:
                qualifier = value
            covered[start:end] = b"\1" * size
            last = end
        if qualifier is None:  # one that overlaps a shorter mention before it
            whole = [(size, end + 1, v) for end, (size, kind, v) in self.automaton.iter(t) if kind == "q" and (end + 1 == len(t) or not t[end + 1].isalpha())]
            if whole:
                size, end, qualifier = max(whole)
                covered[end - size : end] = b"\1" * size
        if not series or qualifier is None:
            rest = "".join(" " if c else x for c, x in zip(covered, t))
            for run in _LETTERS.findall(rest):
                if not series and len(run) >= 5:
                    near = self._near(run)
                    if near:
                        series = sorted(near)
                        continue
                    # a qualifier written onto a mistyped series
                    for n in range(3, min(len(run) - 4, 14)):
                        for affix, rest_ in ((run[:n], run[n:]), (run[-n:], run[:-n])):
                            if affix in self.qualifiers and (near := self._near(rest_)):
                                series, qualifier = sorted(near), qualifier or self.qualifiers[affix]
                    if series:
                        continue
                if qualifier is None and len(run) >= 4:
                    near = {q for f in deletion_forms(run) for q in self.qualifier_forms.get(f, ()) if _one_edit(run, q)}
                    if len(near) == 1:
                        qualifier = near.pop()
            if not series and qualifier is not None and number is not None:
                runs = [run for run in dict.fromkeys(_LETTERS.findall(rest)) if 4 <= len(run) <= 40]
                scored = [self.similar.nearest(run, SIMILAR_SERIES) for run in runs]
                score = max((x for x, _ in scored), default=0.0)
                series = sorted({s for run, (x, of) in zip(runs, scored) if x == score for s in of if _edits(run, s) <= 2})
        return series, qualifier, number, brand, score if series else 0.0

    def candidates(self, name: str, brand: str | None) -> tuple[float, bool, list[tuple], str | None, str | None]:
        """Similarity of the series, whether a number is stated, the products that fit, the brand given and the one named."""
        series, qualifier, number, named, score = self.parse(name)
        found = [p for s in dict.fromkeys(series) for p in self.by_key.get((s, qualifier or ""), ()) if number is None or p[0] == number]
        return score, number is not None, found, self._brand(brand), named

    def resolve(self, name: str, brand: str | None) -> str | None:
        """The product meant, or None."""
        return resolved([self], name, brand)

    def _brand(self, brand: str | None) -> str | None:
        if not brand:
            return None
        if brand not in self.brands:
            f = fold(brand).strip()
            self.brands[brand] = f if f in self.brand_names else next((w for w in _SEPARATORS.split(f) if w in self.brand_names), None)
        return self.brands[brand]


def resolved(lists: list[ProductList], name: str, brand: str | None) -> str | None:
    return chosen([p.candidates(name, brand) for p in lists])


def chosen(read: list[tuple[float, bool, list[tuple], str | None, str | None]]) -> str | None:
    """The product meant among what the slices of a list give, or None: the most similar series of all slices count.

    A series two edits off needs the product's own qualifier, number and brand beside it.
    """
    best = max((r[0] for r in read), default=0.0)
    if not best:
        return None
    read_best = [r for r in read if r[0] == best]
    found = [p for r in read_best for p in r[2]]
    owner = next((r[k] for k in (3, 4) for r in read if r[k]), None)
    if best < 1:  # similarity alone cannot tell a mistyped series from one that the list lacks
        found = [p for p in found if p[1] == owner]
    elif len(found) > 1 or owner and not all(r[1] for r in read_best):
        found = [p for p in found if p[1] == owner] if owner else found
    return found[0][2] if len(found) == 1 else None


class SpecList:
    """Spec attributes by every compact name."""

    def __init__(self, specs: list[tuple[str, str, str]]):
        self.exact = {k for k, _, _ in specs}
        names = defaultdict(set)
        for key, nl, en in specs:
            for name in (key, nl, en, *SPEC_ALIASES.get(key, ())):
                for form in (self.compact(name or ""), self.compact(re.sub(r"\s*\([^()]*\)\s*$", "", name or ""))):
                    if form:
                        names[form].add(key)
        self.names = {n: k.copy().pop() for n, k in names.items() if len(k) == 1}
        words = defaultdict(set)
        for key, nl, en in specs:
            for name in (key, nl, en, *SPEC_ALIASES.get(key, ())):
                for form in (self.words(name or ""), self.words(re.sub(r"\s*\([^()]*\)\s*$", "", name or ""))):
                    words[form].add(key)
        self.similar = PairIndex({w: k.copy().pop() for w, k in words.items() if w and len(k) == 1})
        self.forms = defaultdict(set)
        self.automaton = ahocorasick.Automaton()
        for n in self.names:
            self.automaton.add_word(n, n)
            if len(n) >= 5:
                for f in deletion_forms(n):
                    self.forms[f].add(n)
        if self.names:
            self.automaton.make_automaton()

    @staticmethod
    def compact(text: str) -> str:
        """Letters and digits of the folded text; Greek letters stay, as they name quantities."""
        t = unicodedata.normalize("NFKD", text.casefold().replace("µ", "μ"))
        return "".join(c for c in t.translate(_CYRILLIC) if c.isalnum())

    @classmethod
    def words(cls, text: str) -> str:
        return " ".join(w for x in _SEPARATORS.split(text) if (w := cls.compact(x)))

    def resolve(self, entered: str) -> str | None:
        """The attribute meant, or None."""
        return chosen([self.candidate(entered)])

    def candidate(self, entered: str) -> tuple[float, bool, list[tuple], None, None]:
        """How near the nearest names are (the very name first, then one edit, a mention that fills the value, similarity) and their attributes."""
        score, keys = self._nearest(entered)
        return score + 1 if keys else 0.0, True, [("", "", k) for k in sorted(keys)], None, None

    def _nearest(self, entered: str) -> tuple[float, set[str]]:
        bracketless = re.sub(r"\s*\([^()]*\)\s*:?\s*$", "", entered)
        whole, bare = self.compact(entered), self.compact(bracketless)
        for score, name in ((4.0, whole), (3.0, bare)):
            if name in self.names:
                return score, {self.names[name]}
        if len(bare) < 5:
            return 0.0, set()
        near = {self.names[n] for f in deletion_forms(bare) for n in self.forms.get(f, ()) if _one_edit(bare, n)}
        if len(near) == 1:
            return 2.0, near
        best = max((n for _, n in self.automaton.iter_long(bare)), key=len, default="") if self.names else ""
        if len(best) >= 5 and len(best) >= 0.8 * len(bare):
            return 1.0 + len(best) / 1e6, {self.names[best]}
        return self.similar.nearest(self.words(bracketless), SIMILAR_SPEC)


_CYRILLIC = str.maketrans("аеорсухіјѕ", "aeopcyxijs")


def map_claims(claims: DataFrame, products: DataFrame, spec_attributes: DataFrame) -> DataFrame:
    """(answer_claim_id, field_name, ref_key) of every entered product name and spec key that is no entry of its list.

    Null values give no row, an empty text is ``unmatched``. A name that fits several products is ``unmatched`` unless
    the brand decides. Repeated claims each give their row. Lists that fit one broadcast take one narrow map: no shuffle,
    so a product or brand that holds any share of the rows costs nothing more. A longer list is passed over the distinct
    entered values in slices, with the same result.
    """
    specs = _taken(spec_attributes.select("spec_key", "name_nl", "name_en"))
    listed = _taken(products.select("product_id", "brand_name", "product_name"))
    if specs is None or listed is None:
        return _sliced(claims, products, "product_name").unionByName(_sliced(claims, spec_attributes, "spec_key"))
    handle, spec_handle = (claims.sparkSession.sparkContext.broadcast(x) for x in (listed, specs))

    def run(batches):
        products_, specs_ = ProductList(handle.value), SpecList(spec_handle.value)
        product = remembered(lambda key: resolved([products_], *key))
        spec = remembered(specs_.resolve)
        for b in batches:
            ids, fields, keys = [], [], []
            for i, name, brand, entered in zip(*(b.column(k).to_pylist() for k in range(4))):
                if name is not None and name not in products_.exact:
                    ids.append(i), fields.append("product_name"), keys.append(product((name, brand)))
                if entered is not None and entered not in specs_.exact:
                    ids.append(i), fields.append("spec_key"), keys.append(spec(entered))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(keys, pa.string())], ["answer_claim_id", "field_name", "ref_key"])

    return claims.select("answer_claim_id", "product_name", "brand_name", "spec_key").mapInArrow(run, "answer_claim_id bigint, field_name string, ref_key string")


def _taken(df: DataFrame) -> list[tuple] | None:
    """The rows of a list that fits a broadcast, else None."""
    rows = df.limit(LIST_BOUND + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= LIST_BOUND else None


def remembered(resolve):
    """A resolution that keeps what it found, up to ``CACHE`` values."""
    seen: dict = {}

    def look(key):
        if key not in seen:
            if len(seen) >= CACHE:
                seen.clear()
            seen[key] = resolve(key) or "unmatched"
        return seen[key]

    return look


def _sliced(claims: DataFrame, entries: DataFrame, field: str) -> DataFrame:
    """The rows of one field by a list of any length: distinct entered values against one slice of the list after the other.

    Entries of one series (of one spec) stay in one slice.
    """
    of_products = field == "product_name"
    columns = ["product_id", "brand_name", "product_name"] if of_products else ["spec_key", "name_nl", "name_en"]
    entered = ["product_name", "brand_name"] if of_products else ["spec_key"]
    values = checkpointed(claims.select(*entered).distinct().where(F.col(field).isNotNull()).join(entries.select(field).distinct(), field, "left_anti").select(*entered))
    k = -(-entries.count() // LIST_BOUND) or 1
    part = entries.select(*columns, F.pmod(F.xxhash64(F.lower(F.regexp_extract(field, r"^\S+", 0))), F.lit(k)).alias("slice"))
    read = "score double, numbered boolean, found array<struct<number:string,brand:string,id:string>>, given string, named string"
    kinds = [pa.float64(), pa.bool_(), pa.list_(pa.struct([("number", pa.string()), ("brand", pa.string()), ("id", pa.string())])), pa.string(), pa.string()]
    parts = []
    for i in range(k):
        handle = claims.sparkSession.sparkContext.broadcast([tuple(r)[:-1] for r in part.where(F.col("slice") == i).collect()])

        def run(batches, handle=handle):
            listed = ProductList(handle.value) if of_products else SpecList(handle.value)
            for b in batches:
                rows = zip(*(c.to_pylist() for c in b.columns))
                got = [listed.candidates(*r) if of_products else listed.candidate(*r) for r in rows]
                cols = list(zip(*got)) or [()] * 5
                cols[2] = [[dict(zip(("number", "brand", "id"), p)) for p in found] for found in cols[2]]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds))], [*b.schema.names, "score", "numbered", "found", "given", "named"])

        schema = ", ".join([*(f"{c} string" for c in entered), read])
        parts.append(checkpointed(values.mapInArrow(run, schema).withColumn("slice", F.lit(i))))
        handle.destroy()
    answer = F.struct("slice", "score", "numbered", "found", "given", "named")
    gathered = reduce(DataFrame.unionByName, parts).groupBy(*entered).agg(F.array_sort(F.collect_list(answer)).alias("read"))  # one a slice

    @F.pandas_udf("string")
    def choose(read: pd.Series) -> pd.Series:
        return read.map(lambda rs: chosen([(r["score"], r["numbered"], [(p["number"], p["brand"], p["id"]) for p in r["found"]], r["given"], r["named"]) for r in rs]) or "unmatched")

    found = gathered.select(*(F.col(c).alias(f"_{c}") for c in entered), choose("read").alias("ref_key"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in entered))
    return claims.select("answer_claim_id", *entered).join(found, same).select("answer_claim_id", F.lit(field).alias("field_name"), "ref_key")
