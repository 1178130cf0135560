"""Benchmark decontamination (operator 10): pigeonhole pieces and Myers distance.

Texts are compared lower-cased, with every run of non-word characters as one
space.  A test item of ``n`` characters may differ from a passage of a document
in ``k = n * BUDGET_PERCENT // 100`` edits.  Cut into ``k + 1`` pieces, at least
one piece must then stand in the passage unchanged; an Aho-Corasick automaton
over all pieces finds these hits in one pass over the whole text, and Myers'
bit-parallel search verifies the item against the text around each hit.

Documents are mapped in place: there is no shuffle.  The test set is collected
in blocks of at most ``BLOCK_CHARS`` characters, one pass over the documents per
block, so nothing of unbounded size is sent to the executors.

Items of fewer than ``MIN_CHARS`` characters cannot be told from ordinary prose when
edited; they are found as exact runs of whole words.

Defined cases: null and empty documents match nothing; null items and items
without a word character are in no document.  Items repeated under one ``item_id`` count
once, with the smallest distance; ties between places go to the first.  Repeated
document rows each report.  Extra columns are ignored (stage function: kept).
Empty tables give an empty result (stage function: every document).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET_PERCENT = 6
MIN_CHARS = 20
BLOCK_CHARS = 8_000_000

_NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def budget(n: int, percent: int) -> int:
    return n * percent // 100 if n >= MIN_CHARS else 0


def whole_words(doc: str, a: int, b: int) -> bool:
    return (a == 0 or doc[a - 1] == " ") and (b == len(doc) or doc[b] == " ")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces with their offsets, of lengths that differ by one at most."""
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def best_match(item: str, text: str, k: int) -> tuple[int, int] | None:
    """Smallest edit distance of ``item`` to any substring of ``text`` if it is at
    most ``k``, with the first end of such a substring (Myers 1999)."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(item):
        masks[ch] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], percent: int):
        self.items, self.percent = items, percent
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for row, (_, item) in enumerate(items):
            for at, piece in pieces(item, budget(len(item), percent)):
                places[piece].append((row, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def search(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """item id -> (distance, end in the normalised text, item length)."""
        if self.empty or not text:
            return {}
        doc = normalise(text)
        around: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(doc):
            for row, at in where:
                n = len(self.items[row][1])
                k = budget(n, self.percent)
                begin = last + 1 - size - at
                if n < MIN_CHARS and not whole_words(doc, begin, begin + n):
                    continue
                around[row].append((max(0, begin - k), min(len(doc), begin + n + k)))
        found: dict[object, tuple[int, int, int]] = {}
        for row, spans in around.items():
            item_id, item = self.items[row]
            k = budget(len(item), self.percent)
            spans.sort()
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                if hit := best_match(item, doc[a:b], k):
                    new = (hit[0], a + hit[1], len(item))
                    found[item_id] = min(new, found.get(item_id, new))
        return found


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The test set in blocks of about ``block_chars`` characters, collected one by one."""
    t = items.select("item_id", "text").where("text is not null")
    total = t.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = int(total // block_chars) + 1
    for b in range(blocks):
        part = t.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else t
        rows = [(r["item_id"], normalise(r["text"])) for r in part.distinct().collect()]
        rows = sorted({r for r in rows if r[1]}, key=lambda r: (str(r[0]), r[1]))
        if rows:
            yield rows


def matches(docs: DataFrame, items: DataFrame, percent: int = BUDGET_PERCENT,
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, distance, end_at
    (in the normalised text), item_chars."""
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = (f"doc_id {kinds[0]}, item_id {kinds[1]}, distance bigint, end_at bigint, item_chars bigint")
    out = None
    for rows in item_blocks(items, block_chars):
        def find(batches, rows=rows):
            matcher = Matcher(rows, percent)
            for batch in batches:
                ids, hits = [], []
                for i, text in enumerate(batch.column("text")):
                    for item_id, hit in sorted(matcher.search(text.as_py()).items(), key=lambda x: str(x[0])):
                        ids.append(i)
                        hits.append((item_id, *hit))
                cols = list(zip(*hits)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(ids, pa.int64())),
                     *(pa.array(c, t) for c, t in zip(cols, [None if hits else pa.int64()] + [pa.int64()] * 3))],
                    names=["doc_id", "item_id", "distance", "end_at", "item_chars"])
        part = docs.select("doc_id", "text").mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.limit(0).select("doc_id", F.lit(None).cast(kinds[1]).alias("item_id"),
                                    *(F.lit(None).cast("bigint").alias(c) for c in ("distance", "end_at", "item_chars")))
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, percent: int = BUDGET_PERCENT,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, with the input's columns unchanged."""
    out = docs
    for rows in item_blocks(items, block_chars):
        def keep(batches, rows=rows):
            matcher = Matcher(rows, percent)
            for batch in batches:
                clean = [not matcher.search(text.as_py()) for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))
        out = out.mapInArrow(keep, docs.schema)
    return out
