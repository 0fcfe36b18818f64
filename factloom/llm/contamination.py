"""Evaluation items that leaked into a corpus (problem 6).

Items and documents are read as sequences of words. Windows of an item and windows at every place of a document are embedded by
random walks (CGK) that turn edit distance into Hamming distance; samples of a few embedded places are hashed (bit-sampling LSH),
over several walks, and documents that share a bucket with an item are verified exactly by edit distance on words. Windows of 12
words that agree word by word are a leak without further comparison.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm.names import fold
from factloom.session import spool

#: Words of a window: the shortest passage that counts.
WINDOW = 12
#: Random walks, their steps, samples of each, and places in a sample, one in each equal stretch of the walk. Of simulated 40-word
#: passages with 11 edits, at random or evenly spread, more than 99 in 100 share a sample with their item (tests/llm).
WALKS, STEPS, SAMPLES, PLACES = 3, 18, 3, 6
#: A passage counts with 12 words in a row, or 40 words with at most 11 edits.
RUN, PASSAGE, EDITS = 12, 40, 11
#: Words of the items that some window of a passage that counts has at least: 11 edits leave most room where each breaks a word in
#: two, which spreads 29 words and 22 halves over 51 places, so one of four windows has at most 5 halves.
KNOWN = 7
#: Candidates that are put together at once.
AT_ONCE = 4_000_000
#: Items are matched in blocks of at most so many words, so what is sent to the executors is bounded.
BLOCK_WORDS = 300_000
#: Words times places of items that are compared side by side, and items whose tables are kept for it.
LANES, TABLES = 1_000_000, 1_000
#: Bits of the table that tells which sample keys no item has.
KEY_BITS = 22

_TAG = re.compile(r"<[^<>]{0,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*\r?\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, accents, markup, punctuation and hyphenation at line ends."""
    if not text:
        return []
    text = _BROKEN.sub("", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    folded = text.lower() if text.isascii() else fold(text)
    return _WORD.findall(folded)


class Items:
    """A block of items prepared for matching: their words as numbers, the keys of their windows, and the walks."""

    def __init__(self, rows: list[tuple[int, str | None]], shared_runs: set[int], seed: int = 7):
        self.vocabulary: dict[str, int] = {}
        self.glue: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.glued: list[np.ndarray] = []
        windows, owners = [np.zeros((0, WINDOW), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for item_id, text in rows:
            words = words_of(text)
            if len(words) < RUN:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)
            fresh = np.array([run_hash(words[k : k + RUN]) not in shared_runs for k in range(len(ids) - RUN + 1)], dtype=bool)
            windows.append(_windows(ids)[fresh])
            owners.append(np.full(int(fresh.sum()), len(self.ids), dtype=np.int64))
            self.ids.append(item_id)
            self.words.append(ids)
            self.glued.append(np.array([self.glue.setdefault(a + b, len(self.glue) + 1) for a, b in zip(words, words[1:])], dtype=np.int32))
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, size=(WALKS, STEPS, len(self.vocabulary) + 1), dtype=np.int8)
        stretch = STEPS // PLACES
        self.places = np.arange(PLACES) * stretch + rng.integers(0, stretch, size=(WALKS, SAMPLES, PLACES))
        self.mix = rng.integers(1 << 20, 1 << 62, size=WINDOW, dtype=np.int64) | 1
        self.windows, self.owners = np.concatenate(windows), np.concatenate(owners)
        whole = self.whole_keys(self.windows)
        order = np.argsort(whole, kind="stable")
        self.whole, self.whole_at = whole[order], order
        keys, at = self.sample_keys(self.windows)
        postings = np.unique(np.stack([keys, self.owners[at]]), axis=1)
        self.keys, first = np.unique(postings[0], return_index=True)
        self.first, self.item_at = np.concatenate([first, [postings.shape[1]]]), postings[1]
        self.known_keys = np.zeros(1 << KEY_BITS, dtype=bool)
        self.known_keys[self.keys & ((1 << KEY_BITS) - 1)] = True

    def whole_keys(self, windows: np.ndarray) -> np.ndarray:
        key = (windows * self.mix).sum(axis=1)
        return key ^ (key >> 29)

    def sample_keys(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row of the window) of every sample of every walk."""
        n = len(windows)
        symbols = np.concatenate([windows, np.zeros((n, 1), dtype=windows.dtype)], axis=1).ravel()
        start = np.arange(n) * (WINDOW + 1)
        keys = []
        for walk in range(WALKS):
            place = np.zeros(n, dtype=np.int64)
            sums = np.zeros((SAMPLES, n), dtype=np.int64)
            for step in range(STEPS):
                symbol = symbols[start + place]
                for sample in range(SAMPLES):
                    for k in np.flatnonzero(self.places[walk, sample] == step):
                        sums[sample] += symbol * self.mix[k]
                place += self.bits[walk, step][symbol]
                np.minimum(place, WINDOW, out=place)
            keys += [(key ^ (key >> 29)) * np.int64(WALKS * SAMPLES) + (walk * SAMPLES + sample) for sample, key in enumerate(sums)]
        return np.concatenate(keys), np.tile(np.arange(n), WALKS * SAMPLES)

    def candidates(self, documents: list[list[str]]) -> tuple[dict[tuple[int, int], int], list[tuple[int, int]]]:
        """({(document, item): words in a row} of verbatim leaks, [(document, item)] that share a sample); both by place."""
        get = self.vocabulary.get
        long = [d for d, words in enumerate(documents) if len(words) >= RUN]
        if not long or not len(self.windows):
            return {}, []
        ids = np.array([x for d in long for x in (*(get(w, 0) for w in documents[d]), *(0,) * WINDOW)], dtype=np.int32)
        owner = np.repeat(long, [len(documents[d]) + WINDOW for d in long])
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        known = known[WINDOW:] - known[:-WINDOW]
        windows = _windows(ids)
        verbatim = self._runs(windows, np.flatnonzero(known == WINDOW), owner)
        pairs: set[int] = set()
        at = np.flatnonzero(known >= KNOWN)
        for part in np.array_split(at, max(1, len(at) // 100_000)):
            pairs.update(self._met(windows[part], owner[part]))
        n = len(self.ids)
        return verbatim, [(p // n, p % n) for p in sorted(pairs) if (p // n, p % n) not in verbatim]

    def _runs(self, windows: np.ndarray, at: np.ndarray, owner: np.ndarray) -> dict[tuple[int, int], int]:
        """The longest run of words of every (document, item) that agree in one window at least."""
        keys = self.whole_keys(windows[at])
        left, right = np.searchsorted(self.whole, keys, "left"), np.searchsorted(self.whole, keys, "right")
        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k in np.flatnonzero(right > left).tolist():
            for w in self.whole_at[left[k] : right[k]].tolist():
                if (self.windows[w] == windows[at[k]]).all():
                    met[int(owner[at[k]]), int(self.owners[w])].append(int(at[k]))
        out = {}
        for pair, places in met.items():
            longest = current = 0
            last = -2
            for p in sorted(set(places)):
                current = current + 1 if p == last + 1 else 1
                longest, last = max(longest, current), p
            out[pair] = longest + RUN - 1
        return out

    def _met(self, windows: np.ndarray, owner: np.ndarray) -> set[int]:
        """Document times number of items plus item, of the pairs that share a sample."""
        keys, rows = self.sample_keys(windows)
        some = np.flatnonzero(self.known_keys[keys & ((1 << KEY_BITS) - 1)])
        keys, rows = keys[some], rows[some]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        at, document = at[hit], owner[rows[hit]]
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        found: set[int] = set()
        low = 0
        while low < len(at):
            # as many hits as make up AT_ONCE candidates, one at least
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
            n = sizes[low:high]
            posting = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at[low:high]], n)
            found.update(np.unique(np.repeat(document[low:high], n) * len(self.ids) + self.item_at[posting]).tolist())
            low = high
        return found

    def edited(self, documents: list[list[str]], pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(document, item, edits) of the pairs in whose document 40 words in a row of the item occur with at most ``EDITS`` edits."""
        part: list[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]] = []
        lanes, at, reading = 0, -1, None
        for d, i in pairs:
            if len(self.words[i]) < PASSAGE:
                continue
            if d != at:
                at, reading = d, Reading(documents[d], self)
            for near, own in self._stretches(reading, i):
                part.append((d, i, near, own))
                lanes += near.shape[1] * len(near)
            if lanes > LANES:
                yield from self._confirmed(part)
                part, lanes = [], 0
        yield from self._confirmed(part)

    def _table(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """An item's words in order, and for each of them where it stands in every 40 words in a row, as bits; the last row is empty."""
        if item not in self._tables:
            if len(self._tables) >= TABLES:
                self._tables.clear()
            words = np.unique(self.words[item])
            places = (self.words[item] == np.append(words, -1)[:, None]).astype(np.uint64)
            table = np.zeros((len(words) + 1, places.shape[1] - PASSAGE + 1), dtype=np.uint64)
            for k in range(PASSAGE):
                table |= places[:, k : k + table.shape[1]] << np.uint64(k)
            self._tables[item] = words, table
        return self._tables[item]

    def _stretches(self, reading: Reading, item: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """Stretches of a document in which a passage could lie, as the rows of an item's table that each word may stand for."""
        words, table = self._table(item)
        rows = _places(words, reading.words)
        near = (rows < len(words)).astype(np.int64)
        # (place in the document, row it may stand for as well) of halves of broken words and of words glued together
        others = []
        if len(reading.halves):
            joined = _places(words, reading.joined[reading.halves])
            hit = joined < len(words)
            near[reading.halves[hit]] = 1
            others += [(reading.halves[hit], joined[hit]), (reading.halves[hit] + 1, joined[hit])]
        for j in reading.puts_together.tolist():
            k = np.flatnonzero(self.glued[item] == reading.glued[j])
            if len(k):
                near[j] = 2
                others += [(np.full(len(k), j), _places(words, self.words[item][k + side])) for side in (0, 1)]
        for low, high in _dense(near):
            stands = table[rows[low:high]]
            for at, row in others:
                inside = (at >= low) & (at < high)
                np.bitwise_or.at(stands, at[inside] - low, table[row[inside]])
            yield stands, tuple(a[low:high] for a in (reading.words, reading.joined, reading.glued))

    def _confirmed(self, part: list[tuple[int, int, np.ndarray, tuple[np.ndarray, ...]]]) -> Iterator[tuple[int, int, int]]:
        best: dict[tuple[int, int], int] = {}
        for (d, i, _, own), least in zip(part, fewest_edits([near for _, _, near, _ in part])):
            if least <= EDITS:
                edits = least_edits(self.words[i], self.glued[i], *own)
                best[d, i] = min(edits, best.get((d, i), PASSAGE))
        yield from ((d, i, edits) for (d, i), edits in best.items() if edits <= EDITS)


class Reading:
    """A document's words in the numbers of a block: each word, each with its follower as one word, each as two words of an item."""

    def __init__(self, words: list[str], block: Items):
        get, glue = block.vocabulary.get, block.glue.get
        self.words = np.array([get(w, 0) for w in words], dtype=np.int32)
        self.joined = np.array([*(get(a + b, 0) for a, b in zip(words, words[1:])), 0], dtype=np.int32)
        self.glued = np.array([glue(w, 0) for w in words], dtype=np.int32)
        self.halves, self.puts_together = np.flatnonzero(self.joined), np.flatnonzero(self.glued)


def _places(words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among the words; their count where it is not one of them."""
    at = words.searchsorted(wanted)
    at[words[np.minimum(at, len(words) - 1)] != wanted] = len(words)
    return at


def fewest_edits(stretches: list[np.ndarray]) -> np.ndarray:
    """A lower bound of :func:`least_edits` for each stretch, all places of the item and all stretches side by side.

    Myers' bit-parallel search for 40 words: a lane is one place of the item, a bit one word of the 40. A broken word counts as its
    item word with one more added, two glued words as one of them with the other dropped, so both cost at most what they cost there.
    """
    out = np.full(len(stretches), PASSAGE)
    order = sorted(range(len(stretches)), key=lambda k: -len(stretches[k]))
    if not order:
        return out
    widths = np.array([stretches[k].shape[1] for k in order])
    starts = np.concatenate([[0], np.cumsum(widths)])
    lengths = np.array([len(stretches[k]) for k in order])
    n = int(starts[-1])
    plus, minus = np.full(n, (1 << PASSAGE) - 1, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    score, least = np.full(n, PASSAGE, dtype=np.int16), np.full(n, PASSAGE, dtype=np.int16)
    one, top = np.uint64(1), np.uint64(PASSAGE - 1)
    for step in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -step, "left"))  # stretches that are longer than this step come first
        m = int(starts[live])
        same = np.concatenate([stretches[k][step] for k in order[:live]])
        p, q = plus[:m], minus[:m]
        vertical = same | q
        across = (((same & p) + p) ^ p) | same
        up, down = q | ~(across | p), p & across
        score[:m] += ((up >> top) & one).astype(np.int16) - ((down >> top) & one).astype(np.int16)
        np.minimum(least[:m], score[:m], out=least[:m])
        up <<= one
        down <<= one
        plus[:m], minus[:m] = down | ~(vertical | up), up & vertical
    out[order] = np.minimum.reduceat(least, starts[:-1])
    return out


def _windows(ids: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)


def _dense(near: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a document in which a passage could lie: windows with enough words of the item, put together."""
    width, need = PASSAGE + EDITS, PASSAGE - EDITS
    total = np.zeros(len(near) + 1 + width, dtype=np.int64)
    np.cumsum(near, out=total[1 : len(near) + 1])
    total[len(near) + 1 :] = total[len(near)]
    spans: list[tuple[int, int]] = []
    if total[-1] < need:
        return spans
    for s in np.flatnonzero(total[width : width + len(near)] - total[: len(near)] >= need).tolist():
        e = min(len(near), s + width)
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], e)
        else:
            spans.append((s, e))
    return spans


def run_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def least_edits(item: np.ndarray, item_glued: np.ndarray, doc: np.ndarray, joined: np.ndarray, glued: np.ndarray) -> int:
    """The fewest edits, up to ``EDITS``, with which any 40 words in a row of the item occur anywhere in a stretch of a document.

    An edit replaces, drops or adds one word, breaks one in two or glues two together. All places of the item are computed at
    once, one row of the distance table after the other; places beyond ``EDITS`` are given up, as rows never get smaller.
    """
    offsets = np.arange(len(item) - PASSAGE + 1)
    m = len(doc)
    if not len(offsets) or not m:
        return PASSAGE
    across = np.arange(m + 1, dtype=np.int16)
    row = np.zeros((len(offsets), m + 1), dtype=np.int16)
    previous = row
    pairs = np.isin(item_glued, glued[glued > 0])
    for t in range(PASSAGE):
        word = item[offsets + t][:, None]
        fresh = row + np.int16(1)
        np.minimum(fresh[:, 1:], row[:, :-1] + (word != doc), out=fresh[:, 1:])
        broken = word == joined[:-1]
        if broken.any():
            fresh[:, 2:] = np.where(broken, np.minimum(fresh[:, 2:], row[:, :-2] + 1), fresh[:, 2:])
        if t and pairs[offsets + t - 1].any():
            both = item_glued[offsets + t - 1][:, None] == glued
            fresh[:, 1:] = np.where(both, np.minimum(fresh[:, 1:], previous[:, :-1] + 1), fresh[:, 1:])
        fresh = np.minimum.accumulate(fresh - across, axis=1) + across
        previous, row = row, fresh
        if t % 4 == 3:
            alive = row.min(axis=1) <= EDITS
            if not alive.any():
                return PASSAGE
            offsets, row, previous = offsets[alive], row[alive], previous[alive]
    return int(row.min())


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of bounded size, streamed to the driver one partition at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for item_id, text in items.select(id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct().orderBy(id_col).toLocalIterator():
        n = len(words_of(text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``doc_id``, ``item_id``, ``kind``, ``words``): every document with every item that leaked into it.

    ``kind`` is ``verbatim`` (``words`` in a row, at least 12) or ``edited`` (40 words in a row of the item with at most 11 edits;
    ``words`` is 40 less the edits). Runs of 12 words that occur in several items do not count. Every document is compared at
    every place with all items; documents are not moved. Null and short texts and items under 12 words never match; repeated
    documents and items are judged by id and text, and equal result rows are one. Shared wording is judged over all items,
    of whatever block (see ``BLOCK_WORDS``).
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [docs.schema[doc_id], T.StructField("item_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("words", T.IntegerType())]
    )
    found = None
    runs = spool(shared_runs(items, item_id, item_text), "shared_runs")
    for rows in item_blocks(items, item_id, item_text):
        of_block = runs.filter(F.col("item").between(rows[0][0], rows[-1][0])).select("run").distinct().toPandas()["run"]
        shared = spark.sparkContext.broadcast(prepare(rows, set(of_block.tolist())))
        part = docs.select(doc_id, F.col(text).alias("__text")).mapInPandas(_matcher(shared, doc_id), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy(doc_id, "item_id").agg(F.max(F.struct("kind", "words")).alias("best")).select(doc_id, "item_id", "best.*")


def shared_runs(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``run``, ``item``): the runs of words that occur in several items, with each of these items."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, item, row) for item, text, row in zip(b["item"], b["text"], b["row"]) for h in _runs(words_of(text))]
            yield pd.DataFrame(rows, columns=["run", "item", "row"]).astype("int64")

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null").distinct()
    runs = rows.withColumn("row", F.xxhash64("item", "text")).mapInPandas(cut, "run long, item long, row long")
    several = runs.groupBy("run").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("lo <> hi").select("run")
    return runs.join(several, "run").select("run", "item").distinct()


def _runs(words: list[str]) -> set[int]:
    return {run_hash(words[k : k + RUN]) for k in range(len(words) - RUN + 1)}


def prepare(rows: list[tuple[int, str]], shared: set[int] | None = None) -> Items:
    """A block of items; ``shared`` holds their runs that occur in several items, by default of these rows only."""
    if shared is None:
        counts: Counter = Counter(h for _, t in rows for h in _runs(words_of(t)))
        shared = {h for h, n in counts.items() if n > 1}
    return Items(rows, shared)


def _matcher(shared, doc_id: str):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: Items = shared.value
        for b in batches:
            documents = [words_of(t) for t in b["__text"]]
            ids = b[doc_id]
            verbatim, near = block.candidates(documents)
            rows = [(ids.iloc[d], block.ids[i], "verbatim", n) for (d, i), n in verbatim.items()]
            rows += [(ids.iloc[d], block.ids[i], "edited", PASSAGE - edits) for d, i, edits in block.edited(documents, near)]
            yield pd.DataFrame(rows, columns=[doc_id, "item_id", "kind", "words"])

    return match
