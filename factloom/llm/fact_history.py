"""New batches of facts against all history through a persistent table from pieces of values to values (problem 4).

A folder holds, per appended batch, the facts as numbers, the distinct values they are made of, and the pieces by which spellings of
one value find each other (see :func:`held_pieces`). A batch is cut up once and appended; its values meet all values held so far
through a common piece, those that meet are compared exactly, and the facts of the batch are looked up under every value that says
the same. Facts held before are read as numbers; none is cut up or written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from factloom.functions.text import has_key, value_key
from factloom.llm.names import NICKNAMES, ORG_WORDS, Value, fold, orders, parse, same_value, within_one
from factloom.session import shared_folder, spool

#: The relation schema is broadcast; more relations than this are refused.
MAX_RELATIONS = 50_000
#: Words of one more than the largest value whose words are posted with one another, and how far word counts of one organisation differ.
MANY, APART = 13, 3
#: Stretches of a value of which one is left out to find it in spite of a slip there.
GAPS = 4
#: A word in more asked pieces than this is asked for by its slips (:meth:`FactHistory.met`), and so many pairs of words are sent to all tasks.
OFTEN, AT_HAND = 1000, 200_000


# --- predicates -------------------------------------------------------------------------------------------------------------


def _stems(relation: str) -> frozenset[str]:
    words = [w for w in _split_relation(relation) if w not in ("of", "in", "on", "by", "is", "has", "was", "the", "a", "for", "to", "at", "as", "with")]
    return frozenset(_stem(w) for w in words)


def _split_relation(relation: str) -> list[str]:
    spaced = "".join(" " + c if c.isupper() else c if c.isalnum() else " " for c in relation)
    return fold(spaced).split()


def _stem(word: str) -> str:
    for end in ("ing", "ers", "er", "or", "ed", "es", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 4:
            return word[: -len(end)]
    return word


class Predicates:
    """Classes of predicates of the same meaning, taken from the relation schema.

    Relations with the same description (up to a note after a comma or in parentheses) are one class. A relation without a
    description joins the class of a relation whose name has the same word stems. Any other predicate is its own class, but for
    one slip of typing in a known relation's name.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.of: dict[str, str] = {}
        self.about: dict[str, str] = {}
        stems: dict[frozenset[str], str] = {}
        bare: list[str] = []
        for relation, description in sorted(rows, key=lambda r: (r[0] or "", r[1] or "")):
            key = predicate_key(relation)
            if not key:
                continue
            text = " ".join(fold((description or "").split(",")[0].split(";")[0].split("(")[0]).split())
            if text:
                self.of[key] = text
                self.about[text] = text
                stems.setdefault(_stems(relation or ""), text)
            else:
                bare.append(relation or "")
        for relation in bare:
            self.of.setdefault(predicate_key(relation), stems.get(_stems(relation), predicate_key(relation)))
        self._memo: dict[str, str] = {}
        self._codes: dict[str, int] = {}
        self.places = {class_code(c) for c in self.about if self.is_place(c)}
        self.symmetric = {class_code(c) for c in self.about if self.is_symmetric(c)}

    def code_of(self, predicate: str) -> int:
        """A number for the class of a predicate."""
        code = self._codes.get(predicate)
        if code is None:
            if len(self._codes) > 500_000:
                self._codes.clear()
            code = self._codes[predicate] = class_code(self.class_of(predicate))
        return code

    def class_of(self, predicate: str) -> str:
        key = predicate_key(predicate)
        if key not in self._memo:
            if len(self._memo) > 500_000:
                self._memo.clear()
            found = self.of.get(key)
            if found is None and len(key) >= 5:
                found = next((c for k, c in self.of.items() if within_one(k, key)), None)
            self._memo[key] = found or key
        return self._memo[key]

    def is_place(self, name: str) -> bool:
        """Whether the objects of a class are places, whose names differ by single letters."""
        words = set(self.about.get(name, "").split())
        return bool(words & {"place", "seat", "town", "city", "location"}) and "study" not in words

    def is_symmetric(self, name: str) -> bool:
        """Whether the class has no direction."""
        words = set(self.about.get(name, name).split())
        return bool(words & {"wife", "husband", "spouse", "brother", "sister", "sibling", "partner", "friend", "unspecified"})


def class_code(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode()) - (1 << 63)


def predicate_key(predicate: str | None) -> str:
    return "".join(c for c in fold(predicate or "") if c.isalnum())


def load_predicates(schema: DataFrame) -> Predicates:
    """Read the relation schema, which is a vocabulary and not data; its size is checked before it is brought to the driver."""
    rows = schema.select("relation", "description").distinct().limit(MAX_RELATIONS + 1).collect()
    if len(rows) > MAX_RELATIONS:
        raise ValueError(f"the relation schema has more than {MAX_RELATIONS} relations; it can't be broadcast")
    return Predicates([tuple(r) for r in rows])


# --- pieces of values -------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=100_000)
def slip_pieces(word: str) -> tuple[str, ...]:
    """Pieces of which two words at most one slip apart (:func:`within_one`) always share one.

    Up to eight letters the word and, of five or more, the word less one letter (a word of four meets one of five only); from eight on the halves before and after the middle, of which one
    slip, an exchange of neighbours included, leaves one as it is. As lengths may differ by one, halves are cut for the word's length
    and for one letter less.
    """
    n = len(word)
    out = [word] if n <= 8 else []
    if 5 <= n <= 8:
        out += [word[:i] + word[i + 1 :] for i in range(n)]
    for least in (n - 1, n):
        if least >= 8:
            half = (least - 1) // 2
            out += [f"<{least}{word[:half]}", f">{least}{word[n - half :]}"]
    return tuple(dict.fromkeys(out))



def _fresh_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=200_000)
def _hash(text: str) -> int:
    return _fresh_hash(text)


#: Bits of the usual letters; others share some of the last.
_BITS = {c: i for i, c in enumerate("aeiourntlsmdcgbpkvhf")}


def letters(text: str, bits: int) -> int:
    """The letters of a text as a set of ``bits`` bits, 20 at most."""
    out = 0
    for c in set(text):
        out |= 1 << _BITS.get(c, 15 + ord(c) % 5) % bits
    return out


@lru_cache(maxsize=200_000)
def signature(word: str, rest: str = "") -> int:
    """What two postings must have alike (:func:`may_agree`) if the words and the rests of their names agree, in 31 bits.

    ``rest`` is the third word of a name of three; the last bit says that the word is short enough for an acronym.
    """
    return letters(word, 20) | letters(rest, 10) << 20 | (len(word) <= 4) << 30


def may_agree(a: str, b: str) -> Column:
    """Whether words may be one, by the signatures in two columns.

    A slip changes at most two bits of a set of letters, and a shortened word has no letter that the full word lacks. An acronym
    stands for several words, so two names of three words each have none.
    """
    word, rest = [F.col(x).bitwiseAND(F.lit((1 << 20) - 1)) for x in (a, b)], [F.shiftright(F.col(x), 20).bitwiseAND(F.lit(1023)) for x in (a, b)]
    fits = lambda x, y: (x.bitwiseAND(y) == x) | (x.bitwiseAND(y) == y) | (F.bit_count(x.bitwiseXOR(y)) <= 2)
    acronym = (F.col(a).bitwiseOR(F.col(b)) >= (1 << 30)) & ((rest[0] == 0) | (rest[1] == 0))
    return fits(*rest) & (fits(*word) | acronym)


def _with_gap(value: Value, length: int) -> list[tuple[str, int]]:
    """A value less one of ``GAPS`` stretches, for comparison with one of ``length`` letters; one slip, an exchange included, lies in one.

    What is left goes with the value's numbers, as another number is another value, and with the letters of the stretch left out.
    """
    step, n = -(-length // GAPS), len(value.key)
    out = []
    for start in range(0, length, step):
        after = length - min(length, start + step + 1)
        gap = value.key[start : n - after]
        out.append((f"{length} {' '.join(value.digits)} {value.key[:start]}_{value.key[n - after :]}", letters(gap, 20)))
    return out


@lru_cache(maxsize=200_000)
def _context(word: str, asking: bool) -> frozenset[str]:
    """What a slip leaves of a word: its first letter or, if the slip is there, its end from the third letter on.

    The asking side asks for the ends of words as long, one letter longer and one shorter. An acronym shows all its letters.
    """
    out = {word[0]} | {"~" + word[k:] for k in ((1, 2, 3) if asking else (2,)) if len(word) > k}
    return frozenset(out | set(word) if len(word) <= 4 else out)


@lru_cache(maxsize=200_000)
def _given_context(given: str, asking: bool) -> frozenset[tuple[str, int]]:
    """As :func:`_context`, of a given name and all names it may be short for, each with its letters; an initial fits all."""
    names = {given, *NICKNAMES.get(given, "").split()}
    return frozenset((c, letters(n, 20) if len(n) > 1 else 0) for n in names for c in {n[0], *(c for c in _context(n, asking) if c[0] == "~")})


def _word_pieces(value: Value, asking: bool = False) -> Iterator[tuple[str, str, int]]:
    """(word, context, signature) of the words by which a name is found, whatever its other words look like.

    Names of three words each agree in all of them, so there the signature has the third word too.
    """
    if value.digits:
        return
    if value.is_name and not value.is_org:
        for surname, given in orders(value):
            if given:
                for c, alike in _given_context(given[0], asking):
                    yield surname, "p" + c, alike
    words, n = value.content, len(value.content)
    kind = "g" if value.is_org else "n"
    # of three words or more two must agree with others beside the one they are found by, so one word for a kind of organisation
    # need not be posted for those, but for names of two words
    usual = min((w for w in words if w in ORG_WORDS), default=None) if n >= 3 else None
    for k, word in enumerate(words):
        if len(word) < 4:
            continue
        if n == 1:
            yield word, kind + "1", 0
        elif n < MANY:
            others = words[:k] + words[k + 1 :]
            for i, other in enumerate(others):
                alike = signature(other, others[1 - i] if n == 3 else "")
                marks = ("", "usual ") if asking and n == 2 else ("usual ",) if other == usual and not asking else ("",)
                for c in _context(other, asking):
                    for mark in marks:
                        yield word, kind + mark + c, alike
        if n >= MANY - APART:
            yield word, kind + "many", 0


def held_pieces(text: str) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    """The pieces under which a value is kept: (wholes, words with context).

    Any value that :func:`same_value` accepts asks for one of them (:func:`asked_pieces`): equal keys, dates and numbers and one slip
    in the whole by the wholes; persons by the surname with what a slip, an initial or a short form leaves of the given name;
    organisations by the word they must share with what is left of another word.
    """
    return _unsigned(*held_signed(text))


def _unsigned(wholes: frozenset[tuple[str, int]], words: frozenset[tuple[str, str, int]]) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    return frozenset(w for w, _ in wholes), frozenset((w, c) for w, c, _ in words)


def held_signed(text: str) -> tuple[frozenset[tuple[str, int]], frozenset[tuple[str, str, int]]]:
    """As :func:`held_pieces`, each piece with its signature."""
    value = parse(text)
    if not value.key:
        return frozenset(), frozenset()
    wholes = {(value.key, 0), (value.canonical, 0)}
    if len(value.key) >= 7:
        wholes.update(_with_gap(value, len(value.key)))
    return frozenset(wholes), frozenset(_word_pieces(value))


def asked_pieces(text: str) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    """The pieces a value asks for; words ask for words one slip apart too, which a join with the words held adds.

    A slip may make a value a letter longer or shorter. Organisations ask for values of any kind, other values for organisations.
    """
    return _unsigned(*asked_signed(text))


def asked_signed(text: str) -> tuple[frozenset[tuple[str, int]], frozenset[tuple[str, str, int]]]:
    """As :func:`asked_pieces`, each piece with its signature."""
    value = parse(text)
    if not value.key:
        return frozenset(), frozenset()
    wholes = {(value.key, 0), (value.canonical, 0)}
    n = len(value.key)
    for length in (n - 1, n, n + 1):
        if length >= 7 and n >= 7:
            wholes.update(_with_gap(value, length))
    words = set()
    for word, context, alike in _word_pieces(value, True):
        if context[0] == "p":
            words.add((word, context, alike))
        else:
            words.update((word, kind + context[1:], alike) for kind in ("gn" if context[0] == "g" else "g"))
    return frozenset(wholes), frozenset(words)


def near_words(a: str, b: str) -> bool:
    """Whether two words may pay for each other: equal or one slip apart; words for a kind of organisation only for slips of them."""
    if a in ORG_WORDS and b in ORG_WORDS:
        return False
    return a == b or (min(len(a), len(b)) >= 4 and max(len(a), len(b)) >= 5 and within_one(a, b))


# --- tables -----------------------------------------------------------------------------------------------------------------

_PIECES = T.StructType(
    [
        T.StructField("kind", T.ByteType()),
        T.StructField("word", T.LongType()),
        T.StructField("context", T.LongType()),
        T.StructField("v", T.LongType()),
        T.StructField("alike", T.IntegerType()),
        T.StructField("spelled", T.StringType()),
    ]
)
_FACTS = T.StructType([T.StructField("so", T.LongType()), T.StructField("p", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("born", T.LongType())])
_VALUES = T.StructType([T.StructField("v", T.LongType()), T.StructField("text", T.StringType())])
#: Kinds of rows that values are cut into: wholes, words with context, and the words themselves as they are spelled.
_WHOLE, _WORD, _SPELLED = 0, 1, 2
#: Kind of an asked word for a kind of organisation, which asks for slips of itself and not for itself.
_SLIPS_ONLY = 3
_KEYS = ("k_s", "k_p", "k_o")


def keyed_facts(df: DataFrame, subject: str, predicate: str, obj: str, born: Column) -> DataFrame:
    """(keys, subject, object, ``born``) of the facts that have a key; ``born`` is the place in the order of arrival."""
    rows = df.select(F.col(subject).alias("subject"), F.col(predicate).alias("predicate"), F.col(obj).alias("object"), born.cast("long").alias("born"))
    rows = rows.filter(has_key(F.col("subject")) & has_key(F.col("predicate")) & has_key(F.col("object")))
    return rows.select("subject", "object", "born", *[value_key(F.col(c)).alias(k) for k, c in zip(_KEYS, ("subject", "predicate", "object"))])


def _numbered(facts: DataFrame, predicates: Predicates) -> DataFrame:
    """Facts with numbers for their parts: ``s``, ``o``, both together, the predicate, and its class."""

    @F.arrow_udf("long")
    def class_of(keys: pa.Array) -> pa.Array:
        found = keys.dictionary_encode()
        codes = pa.array([predicates.code_of(k) for k in found.dictionary.to_pylist()], pa.int64())
        return codes.take(found.indices)

    s, o = F.xxhash64("k_s").alias("s"), F.xxhash64("k_o").alias("o")
    return facts.withColumns({"s": s, "o": o}).withColumns({"so": F.xxhash64("s", "o"), "p": F.xxhash64("k_p"), "cls": class_of("k_p")})


def _values(facts: DataFrame) -> DataFrame:
    """(``v``, ``text``): the distinct values of subjects and objects; of the spellings with one key the longest stays."""
    text = facts.select(F.explode(F.array("subject", "object")).alias("text")).distinct()
    keyed = text.select(F.xxhash64(value_key(F.col("text"))).alias("v"), "text")
    return keyed.groupBy("v").agg(F.max(F.struct(F.length("text").alias("n"), "text")).getField("text").alias("text"))


_USUAL = np.array([_hash(w) for w in sorted(ORG_WORDS)], dtype=np.int64)


class _Rows:
    """Rows of the piece table, column by column."""

    def __init__(self):
        self.word: list[int] = []
        self.context: list[int] = []
        self.v: list[int] = []
        self.alike: list[int] = []
        self.spelled: list[str] = []

    def add(self, v: int, wholes: frozenset[tuple[str, int]], words: frozenset[tuple[str, str, int]]) -> None:
        self.word += [_hash(w) for w, _, _ in words]
        self.context += [_hash(c) for _, c, _ in words]
        self.alike += [a for _, _, a in words]
        self.word += [_fresh_hash(w) for w, _ in wholes]
        self.context += [0] * len(wholes)
        self.alike += [a for _, a in wholes]
        self.v += [v] * (len(words) + len(wholes))

    def batch(self) -> pa.RecordBatch:
        n, m = len(self.word), len(self.spelled)
        context = np.array(self.context, dtype=np.int64)
        kind = np.concatenate([np.where(context == 0, _WHOLE, _WORD), np.full(m, _SPELLED)]).astype(np.int8)
        word = np.concatenate([np.array(self.word, dtype=np.int64), np.array([_hash(w) for w in self.spelled], dtype=np.int64)])
        context = np.concatenate([context, np.zeros(m, dtype=np.int64)])
        v = np.concatenate([np.array(self.v, dtype=np.int64), np.zeros(m, dtype=np.int64)])
        alike = np.concatenate([np.array(self.alike, dtype=np.int32), np.zeros(m, dtype=np.int32)])
        spelled = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(self.spelled, pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(word), pa.array(context), pa.array(v), pa.array(alike), spelled], names=_PIECES.names)


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The held pieces of values; every word that may have slips is spelled out once in a task."""
    seen: set[str] = set()
    for b in batches:
        rows = _Rows()
        for v, text in zip(b.column("v").to_pylist(), b.column("text").to_pylist()):
            wholes, words = held_signed(text)
            rows.add(v, wholes, words)
            new = {w for w, _, _ in words if len(w) >= 4} - seen
            seen |= new
            rows.spelled += new
        yield rows.batch()


def _asked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = _Rows()
        for v, text in zip(b.column("v").to_pylist(), b.column("text").to_pylist()):
            rows.add(v, *asked_signed(text))
        made = rows.batch()
        usual = pa.array(np.isin(made.column("word").to_numpy(), _USUAL) & (made.column("context").to_numpy() != 0))
        kind = pc.if_else(usual, pa.scalar(_SLIPS_ONLY, pa.int8()), made.column("kind"))
        yield made.set_column(0, "kind", kind)


def left_by_slips(words: DataFrame) -> DataFrame:
    """(``left``, ``word``): words whole and, of five letters or more, less one letter; two words at most one slip apart always share one.

    Unlike the halves of words, which many words share in a long table, these are shared by few others.
    """
    n = F.length("spelled")
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring("spelled", F.lit(1), i - 1), F.substring("spelled", i + 1, n))))
    whole = F.xxhash64("spelled")
    return words.select(F.explode(F.when(n < 5, F.array(whole)).otherwise(F.array_distinct(F.array_append(less, whole)))).alias("left"), "word")


class FactHistory:
    """All facts so far, in a folder that all executors share; batches are appended and found again when it is reopened.

    Each batch is a folder with the tables ``facts``, ``values`` and ``pieces``; it counts once its marker is written, so a batch whose
    writer was lost is written anew. Nothing that was written is changed.
    """

    def __init__(self, spark: SparkSession, folder: str, predicates: Predicates):
        self.spark, self.folder, self.predicates = spark, folder.rstrip("/"), predicates

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The folders of the batches that were written whole, in the order of arrival."""
        path, files = self._path("")
        if not files.exists(path):
            return []
        names = sorted(str(f.getPath().getName()) for f in files.listStatus(path) if f.isDirectory())
        return [n for n in names if n.startswith("batch-") and files.exists(self._path(f"{n}/_DONE")[0])]

    def _table(self, name: str, schema: T.StructType, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{b}/{name}" for b in batches])

    def append(self, facts: DataFrame) -> str:
        """Cut up facts (as of :func:`keyed_facts`) and append them; the name of the batch."""
        done = self.batches()
        name = f"batch-{int(done[-1][6:]) + 1 if done else 0:06d}"
        target = f"{self.folder}/{name}"
        numbered = _numbered(facts, self.predicates).groupBy("so", "p", "cls").agg(F.min("born").alias("born"))
        numbered.write.mode("overwrite").parquet(f"{target}/facts")
        _values(facts).write.mode("overwrite").parquet(f"{target}/values")
        self._table("values", _VALUES, [name]).mapInArrow(_piece_rows, _PIECES).write.mode("overwrite").parquet(f"{target}/pieces")
        path, files = self._path(f"{name}/_DONE")
        files.create(path, True).close()
        return name

    def accept(self, batch: DataFrame, id_col: str) -> DataFrame:
        """Append facts (as of :func:`keyed_facts`, with the id column beside) and return (``id_col``, ``verdict``) of each.

        A fact is compared with all that arrived before it, in this batch too, whatever became of that; so several batches may come
        at once if ``born`` tells their order.
        """
        name = self.append(batch)
        held = self.batches()
        alias = spool(self._aliases(name, held), "aliases")
        asked = _numbered(batch, self.predicates).select(F.col(id_col), "s", "o", "so", "p", "cls", "born")
        facts = asked.select("s", "o", "so", "p", "cls").distinct()
        subjects = alias.select(F.col("v").alias("s"), F.col("other").alias("s2"), F.col("strict").alias("strict_s"))
        objects = alias.select(F.col("v").alias("o"), F.col("other").alias("o2"), F.col("strict").alias("strict_o"))
        said = facts.join(subjects, "s").join(objects, "o")
        one_of = lambda classes: F.col("cls").isin([int(c) for c in classes]) if classes else F.lit(False)
        straight = said.filter(F.col("strict_o") | ~one_of(self.predicates.places)).select("so", "p", "cls", F.xxhash64("s2", "o2").alias("said"))
        turned = said.filter(one_of(self.predicates.symmetric)).select("so", "p", "cls", F.xxhash64("o2", "s2").alias("said"))
        before = self._table("facts", _FACTS, held).select(F.col("so").alias("said"), F.col("p").alias("p2"), "cls", F.col("born").alias("then"))
        same = (F.col("said") == F.col("so")) & (F.col("p") == F.col("p2"))
        met = straight.unionByName(turned).join(before, ["said", "cls"])
        first = met.groupBy("so", "p").agg(F.min("then").alias("near_born"), F.min(F.when(same, F.col("then"))).alias("first_born"))
        verdict = F.when(F.col("first_born") < F.col("born"), "exact").when(F.col("near_born") < F.col("born"), "near").otherwise("new")
        return asked.select(F.col(id_col), "so", "p", "born").join(first, ["so", "p"]).select(id_col, verdict.alias("verdict"))

    def _aliases(self, name: str, held: list[str]) -> DataFrame:
        """(``v``, ``other``, ``strict``): every value of a batch with all values held that say the same, itself included.

        ``strict`` is false where only a slip, an initial or the like makes them one.
        """
        texts = self._table("values", _VALUES, held).dropDuplicates(["v", "text"])
        own = self._table("values", _VALUES, [name])
        met = self.met(name, held)
        pairs = met.join(own, "v").join(texts.select(F.col("v").alias("other"), F.col("text").alias("other_text")), "other")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                told = list(zip(b.column("text").to_pylist(), b.column("other_text").to_pylist()))
                levels = [same_value(x, y) > 0 for x, y in told]
                kept = b.select(["v", "other"]).filter(pa.array(levels, pa.bool_()))
                strict = [same_value(x, y, False) > 0 for (x, y), k in zip(told, levels) if k]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(strict, pa.bool_())], names=["v", "other", "strict"])

        found = pairs.select("v", "other", "text", "other_text").mapInArrow(confirm, "v long, other long, strict boolean")
        return found.unionByName(own.select("v", F.col("v").alias("other"), F.lit(True).alias("strict"))).groupBy("v", "other").agg(F.max("strict").alias("strict"))

    def met(self, name: str, held: list[str]) -> DataFrame:
        """(``v``, ``other``): the values of a batch with the values held that are compared with them, for a common piece.

        Many organisations share a word and an initial of another, but few of them the letters of their other words; the others are
        left out where they meet, before anything is sent or compared.
        """
        pieces = self._table("pieces", _PIECES, held)
        asked = spool(self._table("values", _VALUES, [name]).mapInArrow(_asked_rows, _PIECES).select("kind", "word", "context", "v", "alike"), "asked")
        own_words = asked.filter(F.col("kind") != _WHOLE)
        slips = self._slips(name, held).join(own_words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
        slips = spool(slips.select("word", "near", (F.col("n") > OFTEN).alias("often")), "slips")
        by_slip = own_words.join(slips.filter("not often"), "word").select(F.xxhash64("near", "context").alias("key"), "v", "alike")
        by_piece = asked.filter(F.col("kind") != _SLIPS_ONLY).select(F.xxhash64("word", "context").alias("key"), "v", "alike")
        kept = pieces.filter(F.col("kind") != _SPELLED).select(F.xxhash64("word", "context").alias("key"), F.col("v").alias("other"), F.col("alike").alias("alike2"))
        # a word that is asked for often has many slips, each in few values; there the values held ask for the word and not the word for all of them
        often = slips.filter("often").select("word", "near")
        often = F.broadcast(often) if often.count() <= AT_HAND else often
        turned = F.xxhash64("word", "context", F.lit(1)).alias("key")
        by_often = own_words.join(often.select("word").distinct(), "word", "left_semi").select(turned, "v", "alike")
        slipped = pieces.filter(F.col("kind") == _WORD).select(F.col("word").alias("near"), "context", F.col("v").alias("other"), F.col("alike").alias("alike2"))
        kept = kept.unionByName(slipped.join(often, "near").select(turned, "other", "alike2"))
        met = by_piece.unionByName(by_slip).unionByName(by_often).join(kept, "key").filter((F.col("v") != F.col("other")) & may_agree("alike", "alike2"))
        return met.select("v", "other").distinct()

    def _slips(self, name: str, held: list[str]) -> DataFrame:
        """(``word``, ``near``): the words of a batch with the words held that are one slip apart."""
        words = lambda batches: self._table("pieces", _PIECES, batches).filter(F.col("kind") == _SPELLED).select("word", "spelled").distinct()
        every, mine = words(held), words([name])
        shared = left_by_slips(mine).join(left_by_slips(every).withColumnRenamed("word", "near"), "left").filter("word <> near").select("word", "near").distinct()
        spelled = shared.join(mine, "word").join(every.select(F.col("word").alias("near"), F.col("spelled").alias("near_spelled")), "near")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept = [near_words(a, c) for a, c in zip(b.column("spelled").to_pylist(), b.column("near_spelled").to_pylist())]
                yield b.select(["word", "near"]).filter(pa.array(kept, pa.bool_()))

        return spelled.select("word", "near", "spelled", "near_spelled").mapInArrow(check, "word long, near long")


def judge_batches(history: DataFrame, proposals: DataFrame, schema: DataFrame) -> DataFrame:
    """Verdicts of batches of proposals in the order of (``batch_no``, ``proposal_id``) against history and earlier proposals.

    The history is appended to a fresh :class:`FactHistory`, all proposals are accepted into it at once; what came before what is
    settled by the order of arrival, so the result is that of going through the batches one by one. Proposals without a key have no
    verdict; a null batch_no comes first. Repeated proposal ids are judged row by row. Empty tables give an empty result.
    """
    kept = FactHistory(history.sparkSession, f"{shared_folder(history.sparkSession)}/history-{uuid.uuid4().hex}", load_predicates(schema))
    order = F.coalesce(F.col("batch_no"), F.lit(0)) * F.lit(1 << 40) + F.col("proposal_id")
    kept.append(keyed_facts(history, "subject", "predicate", "obj", F.lit(-(1 << 62))))
    new = keyed_facts(proposals, "subject", "predicate", "obj", order).withColumn("proposal_id", F.col("born") % F.lit(1 << 40))
    return kept.accept(new, "proposal_id")
