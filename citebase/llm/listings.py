"""Product listings that describe the same item.

Attributes are parsed out of name and specification text and brought to canonical units. Equal parses are one
representative, so a product listed any number of times is compared once. Every two representatives of one number and
close series that agree in all attributes both state meet, by way of the most frequent one of a block whose members all
show the same agreement (``agreeing_pairs``), so a block costs as many comparisons as it has members. Blocks of number and
usual series alone (each with its most frequent member) and the runs' own warnings add pairs that differ. Linkage weights
are fitted by expectation-maximisation over the counts of the agreement patterns, from the prior that a stated attribute is
hardly ever wrong, and decide which pairs are links; links are clustered. A listing that leaves an attribute open and fits
products that differ in it is not joined to either.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citebase.functions.text import deletions, one_edit
from citebase.llm.canonical import fold
from citebase.session import checkpointed

#: Posterior probability from which two representatives are linked.
LINK = 0.5
EM_ROUNDS = 50
#: Levels of agreement: different, not stated on a side, equal, and (series) one edit apart though usually spelled differently.
DIFFERENT, UNSTATED, EQUAL, CLOSE = 0, 1, 2, 3
#: What is held of pairs of one product before any pair is seen, and for how many pairs that counts: a stated attribute never
#: differs (this is not fitted), one series in 30 is mistyped, references are often the seller's own.
NEVER, MISTYPED, OWN_REF, PRIOR_PAIRS = 1e-9, 0.03, 0.3, 10.0
#: What is held of pairs of two products of a block: equal series, one edit apart, equal references; equal numbers, as a
#: block is made by them. How often other attributes agree by chance is counted over all listings, from a share held before.
CHANCE_SERIES, CHANCE_CLOSE, CHANCE_REF, CHANCE_NUMBER = 0.9, 0.05, 0.05, 0.999
CHANCE, PRIOR_LISTINGS = 0.2, 50
FIELDS = ["brand", "series", "number", "size", "thickness", "edge", "colour", "ref"]
#: Attributes in which two listings of one product may not differ.
STRICT = ["brand", "number", "size", "thickness", "edge", "colour"]
#: Those of them that a listing with a series may leave open; a set of them is a number with a bit for each.
OPEN = [c for c in STRICT if c != "number"]

#: Colours in the four languages.
COLOURS = {
    "white": "wit white weiss blanc blanche witte",
    "black": "zwart black schwarz noir noire zwarte",
    "grey": "grijs grey gray grau gris grise grijze",
    "green": "groen green grun vert verte groene",
    "oak": "eiken oak eiche chene eikenhout",
    "beige": "beige",
    "blue": "blauw blue blau bleu",
    "red": "rood red rot rouge",
    "brown": "bruin brown braun brun marron",
    "yellow": "geel yellow gelb jaune",
    "silver": "zilver silver silber argent",
    "anthracite": "antraciet anthracite anthrazit",
    "cream": "creme cream crème ivoor ivory",
}
#: Legal forms and additions after a brand.
BRAND_ADDITIONS = r"\s+(?:b\.?v\.?|n\.?v\.?|gmbh|s\.?a\.?|group|ceilings|ag|ltd|inc)\.?$"
#: Words that are no series name.
NO_SERIES = frozenset(
    "deckenplatte plafondplaat plafond systeemplafond paneel panneau dalle ceiling panel acoustic akoestisch tile levering livraison rapide leverbaar delivery korting aanbieding kwaliteit premium bestseller specs specificaties merkmale details colour kleur dikte dicke thickness edge kant kante rand bord breed lang meter promo doos".split()
)

_COLOUR = {w: c for c, ws in COLOURS.items() for w in ws.split()}
_NUM = r"(\d+(?:[.,]\d+)?)"
_UNIT = r"(mm|cm|meter|m|inch|in|\"|″|'')"
_SIZE = re.compile(rf"(?<![\d.,]){_NUM}\s*(?:{_UNIT})?\s*[x×*]\s*{_NUM}\s*(?:{_UNIT}(?![a-z]))?")
_SIDES = re.compile(rf"\bl\s*{_NUM}\s*{_UNIT}?\s*[,;x×/]?\s*b\s*{_NUM}\s*{_UNIT}?(?![a-z])|{_NUM}\s*{_UNIT}\s*(?:breed|wide|breit|large)\s*[,;/]?\s*{_NUM}\s*{_UNIT}\s*(?:lang|long)\b")
_THICK = re.compile(rf"(?:dikte|dicke|thickness|thk\.?|epaisseur|ep\.?|\bd\s*=|\bt\s*=)\s*:?=?\s*{_NUM}\s*{_UNIT}?(?![a-z\d])")
_BARE_THICK = re.compile(rf"(?<![\d.,a-z-]){_NUM}\s*(mm|cm|m|in|\"|″)(?![a-z\d])")
_EDGE = re.compile(r"(?<![a-z\d])(?:(?:edge type|edge|kante|kant|rand|bord)\s*:?\s*)?(sl|[a-g])[ -]?(\d{1,2})(?!\d|[.,]\d|[a-z]|\s*(?:mm|cm|x))")
_SERIES = re.compile(r"([a-z]{5,})(?:\s|-|_|/|\.|:)*(\d{2,4})(?![\d%])")
_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "meter": 1000.0, "in": 25.4, "inch": 25.4, '"': 25.4, "″": 25.4, "''": 25.4}


def _mm(value: str, unit: str | None) -> float:
    x = float(value.replace(",", "."))
    return x * (_MM[unit] if unit else 1.0)


def parse(brand: str | None, name: str | None, spec: str | None, ref: str | None) -> tuple:
    """brand, series, number, size, thickness, edge, colour, ref; None where a listing does not state one."""
    texts = [fold(t) for t in (name, spec) if t]
    t = " ; ".join(texts).replace("<b>", " ").replace("</b>", " ")
    size = thickness = edge = colour = series = number = None

    def sized(m: re.Match) -> str:
        nonlocal size
        g = [x for x in m.groups()]
        if m.re is _SIDES:
            a, ua, b, ub = g[:4] if g[0] else g[4:]
        else:
            a, ua, b, ub = g[0], g[1], g[2], g[3]
        unit = ub or ua
        sides = sorted(_mm(x, u or unit) for x, u in ((a, ua), (b, ub)))
        if unit is None and sides[1] < 20:
            sides = [s * 1000 for s in sides]
        elif unit is None and sides[0] < 100 and sides[1] <= 300:
            sides = [s * 10 for s in sides]
        if size is None:
            size = "x".join(str(5 * round(s / 5)) for s in sides)
        return " ; "

    t = _SIZE.sub(sized, _SIDES.sub(sized, t))

    def thick(m: re.Match) -> str:
        nonlocal thickness
        mm = _mm(m.group(1), m.group(2))
        if thickness is None and 0 < mm < 200:
            thickness = round(mm)
        return " ; "

    t = _THICK.sub(thick, t)
    t = _BARE_THICK.sub(thick, t)

    def edged(m: re.Match) -> str:
        nonlocal edge
        edge = edge or m.group(1) + m.group(2)
        return " ; "

    t = _EDGE.sub(edged, t)
    for w in re.findall(r"[a-z]+", t):
        if w in _COLOUR:
            colour = _COLOUR[w]
            break
    owner = re.sub(BRAND_ADDITIONS, "", fold(brand).strip()).strip() if brand and brand.strip() else None
    for m in _SERIES.finditer(t):
        if m.group(1) not in NO_SERIES and m.group(1) not in _COLOUR:
            series, number = m.group(1), m.group(2)
            break
    if series and owner and series.startswith(owner) and len(series) > len(owner) + 4:
        series = series[len(owner) :]
    own_ref = fold(ref).strip() if ref and re.fullmatch(r"\s*[a-zA-Z]{2,4}-\d{2,4}\s*", ref) else None
    return owner, series, number, size, thickness, edge, colour, own_ref, t


def parse_listings(listings: DataFrame) -> DataFrame:
    """(listing_id, brand, series, number, size, thickness, edge, colour, ref, rest): the attributes of each listing."""

    def run(batches):
        for b in batches:
            rows = [parse(*r) for r in zip(*(b.column(k).to_pylist() for k in range(1, 5)))]
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["listing_id", *FIELDS, "rest"])

    return listings.select("listing_id", "brand_name", "product_name", "spec_text", "manufacturer_ref").mapInArrow(
        run, "listing_id bigint, brand string, series string, number string, size string, thickness int, edge string, colour string, ref string, rest string"
    )


def _name_brands(parsed: DataFrame) -> DataFrame:
    """The brand of a listing without one, where its text names a brand that other listings have; only such are joined."""
    brands = parsed.where("brand is not null").select("brand").distinct()
    bare = parsed.where("brand is null")
    words = bare.select("listing_id", F.explode(F.array_distinct(F.split("rest", r"[^a-z0-9]+"))).alias("brand")).where("brand <> ''")
    named = words.join(brands, "brand").groupBy("listing_id").agg(F.min("brand").alias("named"), F.max("brand").alias("other")).where("named = other").select("listing_id", "named")
    found = bare.join(named, "listing_id", "left").withColumn("brand", F.col("named")).drop("named")
    return parsed.where("brand is not null").unionByName(found).drop("rest")


def _agreement(a: str, b: str) -> Column:
    return F.when(F.col(a).isNull() | F.col(b).isNull(), UNSTATED).when(F.col(a) == F.col(b), EQUAL).otherwise(DIFFERENT)


def fit_weights(patterns: list[tuple[tuple[int, ...], int]], chance: dict[str, float], fields: list[str] = FIELDS, rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior match probability of every agreement pattern: a two-class model of independent fields, fitted by EM.

    ``chance`` holds how often two listings agree in an attribute by chance. EM fits the share of matches, how series are
    spelled and how references agree in both classes. Fields that are not stated on a side carry no weight. Works on the
    counts of patterns, of which there are at most 4 ** fields however many pairs they stand for.
    """
    total, p = sum(n for _, n in patterns), 0.5
    same, other = [], []
    for f in fields:
        c = {"number": CHANCE_NUMBER, "ref": CHANCE_REF, "series": CHANCE_SERIES}.get(f, min(0.99, max(1e-4, chance.get(f, CHANCE))))
        close = CHANCE_CLOSE if f == "series" else 0.0
        other.append({DIFFERENT: 1 - c - close, EQUAL: c, CLOSE: close})
        typos, differ = (MISTYPED if f == "series" else 0.0), (OWN_REF if f == "ref" else NEVER)
        same.append({DIFFERENT: differ, EQUAL: 1 - differ - typos, CLOSE: typos})
    before = [dict(x) for x in same], [dict(x) for x in other]

    def posterior(g: tuple[int, ...]) -> float:
        odds = math.log(p / (1 - p)) + sum(math.log(same[i][x] / other[i][x]) for i, x in enumerate(g) if x != UNSTATED)
        return 1 / (1 + math.exp(-max(-500, min(500, odds))))

    def refit(model: dict[int, float], held: dict[int, float], seen: dict[int, float], levels: tuple[int, ...]) -> None:
        """Shares of the fitted levels among the pairs seen and those held before; the other levels keep theirs."""
        free, whole = sum(held[x] for x in levels), sum(seen[x] + PRIOR_PAIRS * held[x] for x in levels)
        model.update({x: free * (seen[x] + PRIOR_PAIRS * held[x]) / whole for x in levels})

    for _ in range(rounds if patterns else 0):
        post = [posterior(g) for g, _ in patterns]
        p = min(0.999, max(0.001, sum(q * n for q, (_, n) in zip(post, patterns)) / total))
        for model, held, weights in ((same, before[0], post), (other, before[1], [1 - q for q in post])):
            for i, f in enumerate(fields):
                if f in ("series", "ref"):
                    seen = {x: sum(q * n for q, (g, n) in zip(weights, patterns) if g[i] == x) for x in (DIFFERENT, EQUAL, CLOSE)}
                    refit(model[i], held[i], seen, (EQUAL, CLOSE) if f == "series" else (DIFFERENT, EQUAL))
    return {g: posterior(g) for g, _ in patterns}


def chance_agreement(reps: DataFrame) -> dict[str, float]:
    """How often two listings agree by chance in each attribute both state: the sum of the squared shares of its values,
    together with ``PRIOR_LISTINGS`` that agree in a share of ``CHANCE``."""
    names = [c for c in STRICT if c != "number"]
    values = reps.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))).alias("v"))
    counted = values.where("v.value is not null").groupBy("v.field", "v.value").agg(F.sum("n").cast("double").alias("n"))
    shares = counted.groupBy("field").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("alike")).collect()
    return {r.field: (r.alike + PRIOR_LISTINGS * CHANCE) / (r.n + PRIOR_LISTINGS) for r in shares}


def usual_series(reps: DataFrame) -> DataFrame:
    """(number, series, usual): the most listed spelling one edit away from a series of the same number, itself included.

    Two mistyped names can be two edits apart; both are one from the usual one.
    """
    spelled = reps.where("series is not null and number is not null").groupBy("number", "series").agg(F.sum("n").alias("n"))
    forms = spelled.withColumn("form", F.explode(deletions(F.col("series"))))
    best = forms.groupBy("number", "form").agg(F.max(F.struct("n", "series")).alias("best"))
    near = forms.join(best, ["number", "form"]).where(one_edit(F.col("series"), F.col("best.series")))
    return near.groupBy("number", "series").agg(F.max("best").alias("best")).select("number", "series", F.col("best.series").alias("usual"))


def close_series(usual: DataFrame) -> DataFrame:
    """(number, series, other): spellings of a number one edit apart whose usual spellings differ, either way round.

    Few spellings share a one-deletion form, however many listings there are.
    """
    forms = usual.where("usual is not null").select("number", "series", "usual").distinct().withColumn("form", F.explode(deletions(F.col("series"))))
    others = forms.select("number", "form", F.col("series").alias("other"), F.col("usual").alias("other_usual"))
    near = forms.join(others, ["number", "form"]).where((F.col("usual") != F.col("other_usual")) & one_edit(F.col("series"), F.col("other")))
    return near.select("number", "series", "other").distinct()


def agreeing_pairs(usual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all representatives of close series that contradict each other in no attribute, and
    (id, open, unclear) with the attributes a representative leaves open and those of them in which its partners differ.

    A block holds the representatives that leave open one set of attributes and those that leave open another, with equal
    values in all the rest: each of a side agrees with each of the other side, in the same attributes. So meeting the most
    frequent one of the other side (of any reference, of none and of the same one, as references may differ) connects
    whatever all pairs of the block would connect. One that leaves open what its partners differ in meets only those that
    leave it open too: it would bridge different products.
    """
    bits = [F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(OPEN)]
    known = usual.where("usual is not null").withColumn("open", sum(bits[1:], bits[0]))
    masks = sorted(r["open"] for r in known.select("open").distinct().collect())  # at most 2 ** 5
    spelled = [F.struct(F.concat_ws("|", "number", F.lit("="), "usual").alias("name"), F.lit("").alias("own"), F.lit("").alias("others"))]
    alike = known.select("id", "n", "ref", "open", "number", *OPEN, *(s.alias("s") for s in spelled))
    bond = F.struct(F.concat_ws("|", "number", F.least("series", "other"), F.greatest("series", "other")).alias("name"), F.col("series").alias("own"), F.col("other").alias("others"))
    near = known.join(close_series(usual), ["number", "series"]).select("id", "n", "ref", "open", "number", *OPEN, bond.alias("s"))
    rows = alike.union(near).withColumn("facing", F.explode(F.array(*(F.lit(m) for m in masks)))) if masks else alike.union(near).withColumn("facing", F.lit(0))
    either = F.col("open").bitwiseOR(F.col("facing"))
    values = [F.when(either.bitwiseAND(1 << k) == 0, F.col(c).cast("string")).otherwise("*") for k, c in enumerate(OPEN)]
    block = F.concat_ws("|", "s.name", F.least("open", "facing"), F.greatest("open", "facing"), *values)
    sides = [F.concat_ws("|", "s.own", "open").alias("side"), F.concat_ws("|", "s.others", "facing").alias("across")]
    # a block's name is long and shuffled several times, so two hashes stand for it: 96 bits, and whatever met by chance is compared
    members = rows.select("id", "n", "ref", "open", "facing", *OPEN, F.struct(F.xxhash64(block).alias("a"), F.hash(block).alias("b")).alias("block"), *sides)
    # one that is alone in its block meets nobody
    crowded = members.groupBy("block").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("block")
    members = checkpointed(members.join(crowded, "block", "left_semi"))

    stated = members.groupBy("block", "side").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in OPEN for f in (F.min, F.max)))
    heard = members.where("open <> 0").select("id", "open", "block", F.col("across").alias("side")).join(stated, ["block", "side"])
    heard = heard.groupBy("id").agg(F.first("open").alias("open"), *(F.min(f"min_{c}").alias(f"min_{c}") for c in OPEN), *(F.max(f"max_{c}").alias(f"max_{c}") for c in OPEN))
    differ = [F.when((F.col(f"min_{c}") != F.col(f"max_{c}")) & (F.col("open").bitwiseAND(1 << k) != 0), 1 << k).otherwise(0) for k, c in enumerate(OPEN)]
    unclear = heard.select("id", sum(differ[1:], differ[0]).alias("unclear")).where("unclear <> 0")
    judged = checkpointed(known.select("id", "open").join(unclear, "id", "left").select("id", "open", F.coalesce("unclear", F.lit(0)).alias("unclear")))

    met = members.join(judged.select("id", "unclear"), "id").where(F.col("unclear").bitwiseAND(F.bitwise_not("facing")) == 0)
    ref = F.concat(F.lit("="), F.col("ref"))
    hubs = met.withColumn("which", F.explode(F.array(F.lit("*"), F.coalesce(ref, F.lit("?"))))).groupBy("block", "side", "which").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"))
    seeking = met.select("id", "block", F.col("across").alias("side"), F.explode(F.array_distinct(F.array(F.lit("*"), F.lit("?"), F.coalesce(ref, F.lit("?"))))).alias("which"))
    pairs = seeking.join(hubs, ["block", "side", "which"]).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return pairs, judged


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) by propagating the least label along edges until none changes; every round cuts its lineage.

    Only nodes with an edge take part in the rounds; the others are components of their own.
    """
    both = checkpointed(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    linked = both.select(F.col("a").alias("id")).distinct()
    labels = checkpointed(linked.withColumn("component", F.col("id")))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min("component").alias("heard"))
        step = labels.join(heard, F.col("id") == F.col("b"), "left").select("id", F.least("component", F.coalesce("heard", "component")).alias("next"), "component")
        # a node also takes the label of the node its label names
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        step = checkpointed(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("next"), "component"))
        changed = step.where("next <> component").limit(1).count()
        labels = step.select("id", F.col("next").alias("component"))
        if not changed:
            break
    alone = nodes.select("id").join(linked, "id", "left_anti").withColumn("component", F.col("id"))
    return labels.unionByName(alone)


def group_listings(listings: DataFrame, extraction_runs: DataFrame | None = None) -> DataFrame:
    """(listing_id, group_id, links): each listing with its group, named by the group's least listing, and its number of links.

    A listing without series and number stands alone. Null texts parse to nothing; repeated listings share a group.
    Listings of one parse are one representative, so a hot product is compared as often as it is spelled differently.
    """
    parsed = checkpointed(_name_brands(checkpointed(parse_listings(listings))))
    own = ["brand", "series", "number", "size", "thickness", "edge", "colour"]
    signature = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in own))
    signed = parsed.withColumn("signature", F.when(F.col("series").isNull(), F.concat(F.lit("#"), F.col("listing_id").cast("string"))).otherwise(signature))
    reps = checkpointed(signed.groupBy("signature", *own).agg(F.min("listing_id").alias("id"), F.count("*").alias("n"), F.min("ref").alias("ref")))
    usual = checkpointed(reps.join(usual_series(reps), ["number", "series"], "left"))
    blocks = usual.where("usual is not null").select("id", "n", F.concat_ws("|", "number", "usual").alias("block"))
    hubs = blocks.groupBy("block").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("hub"), F.count("*").alias("size")).where("size > 1")
    pairs = blocks.join(hubs, "block").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    agreeing, judged = agreeing_pairs(usual)
    pairs = pairs.union(agreeing)
    if extraction_runs is not None:
        hints = extraction_runs.select("run_id", F.explode("possible_duplicate_products").alias("w")).select("run_id", F.col("w.new_name").alias("product_name"), F.col("w.existing_id").alias("old"))
        new = listings.select("listing_id", "run_id", "product_name").join(hints, ["run_id", "product_name"]).select("listing_id", "old")
        rep_of = signed.select("listing_id", "signature").join(reps.select("signature", "id"), "signature").select("listing_id", "id")
        hinted = new.join(rep_of.withColumnRenamed("id", "x"), "listing_id").join(rep_of.select(F.col("listing_id").alias("old"), F.col("id").alias("y")), "old")
        pairs = pairs.union(hinted.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    pairs = pairs.distinct()
    side = lambda s: usual.select(F.col("id").alias(s), F.col("usual").alias(f"{s}_usual"), *(F.col(c).alias(f"{s}_{c}") for c in FIELDS))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = (F.col("a_series") == F.col("b_series")) | (F.col("a_usual") == F.col("b_usual"))
    close = F.when(alike, EQUAL).when(one_edit(F.col("a_series"), F.col("b_series")), CLOSE).otherwise(DIFFERENT)
    levels = [close.alias("g_series") if c == "series" else _agreement(f"a_{c}", f"b_{c}").alias(f"g_{c}") for c in FIELDS]
    compared = checkpointed(both.select("a", "b", *levels))
    g = [f"g_{c}" for c in FIELDS]
    counts = [(tuple(r[c] for c in g), r["count"]) for r in compared.groupBy(*g).count().collect()]  # at most 4 * 3 ** 7 patterns
    linked = [p for p, q in fit_weights(counts, chance_agreement(reps)).items() if q >= LINK]
    accepted = compared.sparkSession.createDataFrame(linked or [(-1,) * len(g)], ", ".join(f"{c} int" for c in g))
    likely = compared.join(F.broadcast(accepted), g, "left_semi").select("a", "b")
    state = lambda x: judged.select(F.col("id").alias(x), F.col("open").alias(f"{x}_open"), F.col("unclear").alias(f"{x}_unclear"))
    bridges = lambda x, y: F.col(f"{x}_unclear").bitwiseAND(F.bitwise_not(f"{y}_open")) != 0
    links = likely.join(state("a"), "a").join(state("b"), "b").where(~(bridges("a", "b") | bridges("b", "a"))).select("a", "b")
    found = components(reps.select("id"), links)
    grouped = reps.select("id", "signature", "n").join(found, "id")
    totals = grouped.groupBy("component").agg(F.min("id").alias("group_id"), (F.sum("n") - 1).alias("links"))
    return signed.select("listing_id", "signature").join(grouped.join(totals, "component").select("signature", "group_id", "links"), "signature").select("listing_id", "group_id", "links")


def same_product_pairs(groups: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b), smaller first, of every two listings of a group."""
    a = groups.where("links > 0").select("group_id", F.col("listing_id").alias("listing_id_a"))
    b = groups.where("links > 0").select("group_id", F.col("listing_id").alias("listing_id_b"))
    return a.join(b, "group_id").where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
