"""Queries of the operators in this subpackage, bound to the driver's tables."""

from __future__ import annotations

from citebase.llm import canonical, leaks, listings, packing, pairs, spam, splitting
from citebase.session import table


def p1_pieces(spark, sf_dir):
    """Every piece of the chunks and page tables over 800 tokens."""
    items = splitting.long_items(table(spark, sf_dir, "document_chunks"), table(spark, sf_dir, "document_pages"))
    return splitting.split_items(items)


def p1_found(spark, sf_dir):
    """Every item over 800 tokens, one row for each that was split."""
    return p1_pieces(spark, sf_dir).where("piece_index = 0").select("item_kind", "item_id", "item_index")


def p2_found(spark, sf_dir):
    """Every entered product name and spec key that is no list entry, with the entry meant or ``unmatched``."""
    return canonical.map_claims(table(spark, sf_dir, "answer_claims"), table(spark, sf_dir, "products"), table(spark, sf_dir, "spec_attributes"))


def p4_found(spark, sf_dir):
    """Every defective answer with its defect."""
    return pairs.find_defects(table(spark, sf_dir, "visibility_answers"), table(spark, sf_dir, "prompts"))


def p5_groups(spark, sf_dir):
    """Every listing with its product group and its number of links."""
    return listings.group_listings(table(spark, sf_dir, "product_listings"), table(spark, sf_dir, "extraction_runs"))


def p5_found(spark, sf_dir):
    """Every pair of listings of the same product."""
    return listings.same_product_pairs(p5_groups(spark, sf_dir))


def p6_containers(spark, sf_dir):
    """Every text in a container of each capacity. ``spark.citebase.tokenizers`` names another folder of vocabularies."""
    folder = spark.conf.get("spark.citebase.tokenizers", packing.FOLDER)
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"), folder)


def p7_leaks(spark, sf_dir):
    """Every document, the evaluation items it leaks, and whether their answers stand in it too."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir):
    """Every document and the evaluation items it leaks."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_found(spark, sf_dir):
    """Every page of keywords, links or tags."""
    return spam.find_spam(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
}

_TOKENS = r"regexp_extract_all({0}, '[^\t\n\x0B\f\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')"
_PLAIN = r"regexp_extract_all(replace(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)</?(?:b|i|u|em|strong|span|a|mark|sup|sub|small|font|wbr)\b[^<>]*>', '', 'g'), '</?[a-zA-Z!][^<>]*>', ' ', 'g'), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g'))), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"
_RUNS = "select {0} as id, k, array_to_string(w[k:k + 15], ' ') as run, ' ' || array_to_string(w[k + 16:k + 31], ' ') || ' ' as after from (select {0}, w, unnest(range(1, len(w) - 14)) as k from (select {0}, " + _PLAIN.replace("{0}", "{1}") + " as w from {2}))"
_LEAKS = f"with d as ({_RUNS.format('doc_id', 'text', 'documents')}), e as ({_RUNS.format('item_id', 'passage', 'eval_items')}), f as (select d.id as doc_id, e.id as item_id, arg_max(d.after, d.k) as after from d join e using (run) group by 1, 2)"

ORACLE: dict[str, str] = {
    "p1_found": f"""select 'chunk' as item_kind, chunk_id as item_id, 0 as item_index from document_chunks where len({_TOKENS.format("content")}) > 800
union all select 'table', page_id, i - 1 from (select page_id, generate_subscripts(page_tables, 1) as i, unnest(page_tables) as t from document_pages)
where list_sum(list_transform(flatten(t.rows), lambda c: len({_TOKENS.format("coalesce(c, '')")}))) > 800""",
    "p7_found": f"{_LEAKS} select doc_id, item_id from f",
    "p7_leaks": f"{_LEAKS} select doc_id, item_id, contains(after, ' ' || array_to_string({_PLAIN.format('answer_key')}, ' ') || ' ') as answer_found from f join eval_items using (item_id)",
}
