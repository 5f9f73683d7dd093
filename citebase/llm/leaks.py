"""Evaluation passages that occur in a corpus, whole or in part.

The passages form a BM25 inverted index, its postings cut into blocks that know their largest weight. Every passage of
every document is a query against it, answered by block-max WAND: only items whose score can reach the threshold are
looked at. Its first test, whether the largest weights of a passage's terms reach the threshold together, is made for all
runs of 16 words of a document at once; neighbouring runs that pass are one query. Each item's weights are divided by the least score that any 16 consecutive words of it
have among themselves, so 1 is the threshold for all, and no window that holds such a run can fall below it. What is
retrieved is then verified word by word, and the item's answer key is looked for in the words that follow.

The index is broadcast in slices of at most ``ITEM_BOUND`` items, one at a time: more items mean more passes over the
corpus, and what a slice finds is stored before its broadcast makes room for the next.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citebase.session import checkpointed

#: Consecutive words that make a leak.
RUN = 16
#: Words after a leaked run among which the item's answer is looked for.
ANSWER = 16
#: Runs in a query at most; each query holds its runs whole.
RUNS = 32
#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Items of a posting block, and items that one broadcast index may hold: about 140 MB in each worker.
BLOCK, ITEM_BOUND = 16, 5_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ­​-‏‪-‮⁠-⁤﻿᠎]")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|mark|sup|sub|small|font|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits without case, accents, markup and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


class Index:
    """BM25 postings of a set of items, scaled to the threshold 1."""

    def __init__(self, items: list[tuple[int, str]]):
        words = {i: w for i, p in items if p and len(w := normal_words(p)) >= RUN}
        self.items = sorted(words)
        n, average = len(words), sum(map(len, words.values())) / max(1, len(words))
        frequency = Counter(t for w in words.values() for t in set(w))
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        postings = defaultdict(list)
        self.passages = [f" {' '.join(words[i])} " for i in self.items]
        self.runs = [{hash(tuple(w[k : k + RUN])) for k in range(len(w) - RUN + 1)} for w in map(words.get, self.items)]
        for slot, i in enumerate(self.items):
            w, tf = words[i], Counter(words[i])
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / average)) for t, f in tf.items()}
            least = min(sum(weight[t] for t in set(w[k : k + RUN])) for k in range(len(w) - RUN + 1))
            for t, x in weight.items():
                postings[t].append((slot, x / least * (1 + 1e-9)))
        self.terms = {t: k for k, t in enumerate(postings, 1)}  # 0 stands for every other word
        self.slots = [[s for s, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.blocks = [[(max(w[k : k + BLOCK]), s[min(k + BLOCK, len(s)) - 1]) for k in range(0, len(s), BLOCK)] for s, w in zip(self.slots, self.weights)]
        self.most = np.array([0.0, *(max(w) for w in self.weights)])

    def retrieve(self, terms: list[int]) -> list[int]:
        """Slots of the items that reach the threshold: block-max WAND over the terms' postings."""
        end = len(self.items)
        cursors = [[self.slots[t - 1][0], t, 0] for t in terms]
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (slot, t, _) in enumerate(cursors):
                if slot == end:
                    break
                bound += self.most[t]
                if bound >= 1.0:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            shallow, until = 0.0, end
            for k in range(pivot + 1):
                _, t, at = cursors[k]
                blocks = self.blocks[t - 1]
                b = at // BLOCK
                while b < len(blocks) and blocks[b][1] < target:
                    b += 1
                if b < len(blocks):
                    shallow += blocks[b][0]
                    until = min(until, blocks[b][1] + 1)
            if shallow >= 1.0:
                if cursors[0][0] == target:
                    score = sum(self.weights[t - 1][at] for _, t, at in cursors[: pivot + 1])
                    if score >= 1.0:
                        found.append(target)
                    goal = target + 1
                else:
                    goal = target
            else:  # no item up to the end of the nearest block can reach it
                goal = max(target + 1, min(until, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                if c[0] < goal:
                    slots, at = self.slots[c[1] - 1], c[2]
                    while at < len(slots) and slots[at] < goal:
                        at += 1
                    c[2], c[0] = at, slots[at] if at < len(slots) else end

    def leaked(self, text: str) -> set[int]:
        """Items of which the text holds a run."""
        words = normal_words(text)
        if len(words) < RUN or not self.items:
            return set()
        ids = np.fromiter(map(self.terms.get, words, repeat(0)), np.int32, len(words))
        upper = np.concatenate(([0.0], np.cumsum(self.most[ids])))
        starts = np.flatnonzero(upper[RUN:] - upper[:-RUN] >= 1.0)
        found: set[int] = set()
        if not starts.size:
            return found
        cuts = np.flatnonzero(np.diff(starts) > 1) + 1
        for stretch in np.split(starts, cuts):
            first, last = int(stretch[0]), int(stretch[-1])
            for start in range(first, last + 1, RUNS):
                found |= self._query(words[start : min(start + RUNS - 1, last) + RUN], found)
        return found

    def words_after(self, text: str, found: list[int]) -> dict[int, str]:
        """The ``ANSWER`` words that follow the last run of each of the items found, parted by blanks."""
        words, slot = normal_words(text), {self.items[s]: s for s in range(len(self.items))}
        out = {}
        for i in found:
            passage = self.passages[slot[i]]
            end = next(k for k in range(len(words), RUN - 1, -1) if f" {' '.join(words[k - RUN : k])} " in passage)
            out[i] = f" {' '.join(words[end : end + ANSWER])} "
        return out

    def _query(self, part: list[str], known: set[int]) -> set[int]:
        terms = {k for w in part if (k := self.terms.get(w, 0))}
        slots = [s for s in self.retrieve(list(terms)) if self.items[s] not in known]
        if not slots:
            return set()
        hashes = [hash(tuple(part[k : k + RUN])) for k in range(len(part) - RUN + 1)]
        # an equal hash is looked at word by word
        return {self.items[s] for s in slots if any(h in self.runs[s] and f" {' '.join(part[k : k + RUN])} " in self.passages[s] for k, h in enumerate(hashes))}


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, answer_found) of every document and item such that the text holds ``RUN`` consecutive words of the
    passage. ``answer_found`` tells whether the item's answer key stands, word for word, among the ``ANSWER`` words after the
    last such run; null for an item without a key.

    Null and short texts and passages give no row; repeated documents each give their rows, an item stored twice one. One
    narrow map for each slice of items over whole texts: no shuffle.
    """
    spark = documents.sparkSession
    slices = -(-eval_items.count() // ITEM_BOUND) or 1
    part = eval_items.select("item_id", "passage", "answer_key", F.pmod(F.xxhash64("item_id"), F.lit(slices)).alias("slice"))
    schema, out = "doc_id bigint, item_id bigint, answer_found boolean", None
    for k in range(slices):
        handle = spark.sparkContext.broadcast([(r.item_id, r.passage, r.answer_key) for r in part.where(F.col("slice") == k).collect()])

        def run(batches, handle=handle):
            index = Index([(i, p) for i, p, _ in handle.value])
            answers = {i: f" {' '.join(w)} " if a and (w := normal_words(a)) else None for i, _, a in handle.value}
            for b in batches:
                docs, items, held = [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = sorted(index.leaked(t)) if t else ()
                    after = index.words_after(t, found) if found else {}
                    for i in found:
                        docs.append(d), items.append(i), held.append(None if answers[i] is None else answers[i] in after[i])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(held, pa.bool_())], ["doc_id", "item_id", "answer_found"])

        found = documents.select("doc_id", "text").mapInArrow(run, schema)
        if slices > 1:
            found = checkpointed(found)
            handle.destroy()
        out = found if out is None else out.unionByName(found)
    return out
