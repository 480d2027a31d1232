"""Language identification by hyperdimensional profiles.

Each letter, of whatever script, has a random bipolar vector of its own, drawn by its code point; so
has the blank. The vector of a trigram binds (multiplies) its letters' vectors, permuted by place:
rho(rho(a)) * rho(b) * c. Signs are kept as packed bits, so that binding is an exclusive or. A
document's vector bundles (adds) those of all its trigrams over the whole text; a language's
prototype bundles the unit vectors of its training documents. The prediction is the prototype
with the largest cosine.

Training reads a bounded sample: ``PER_LANGUAGE`` hash buckets of doc ids, and in each bucket
and language the labelled document with the smallest hash. Every language present is learnt.

Edge cases: null text, or text without a letter, is ``und`` with score 0; ties go to the first
language in alphabetical order; without training rows every text is ``und``; repeated rows are
all returned; letters of any script count, case folded; a long text is bundled a million characters
at a time; columns of the names that are added replace a table's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.llm import bpe
from morphloom.storage import materialize

DIMENSIONS = 1024
SEGMENT = 1 << 20
PER_LANGUAGE = 512
BROADCAST_ROWS = 200_000
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Code point -> code point of the letter in lower case; 0 for what is no letter."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


class Space:
    """The random vectors, equal in every process; a letter's are drawn when it is first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.rho = np.random.default_rng(seed).permutation(dimensions)
        self.table = _letters()
        self.row = np.full(0x110000, -1, np.int32)  # code point -> row of its vectors
        self.places = np.empty((3, 64, dimensions // 8), np.uint8)  # rho(rho(a)), rho(b), c
        self.known = 0

    def vector(self, letter: int) -> np.ndarray:
        """The signs of a letter as bits, 1 for minus."""
        return np.random.default_rng([self.seed, letter]).integers(0, 2, self.dimensions, np.uint8)

    def _rows(self, letters: np.ndarray) -> np.ndarray:
        for x in np.unique(letters[self.row[letters] < 0]).tolist():
            if self.known == self.places.shape[1]:
                self.places = np.concatenate([self.places, np.empty_like(self.places)], 1)
            v = self.vector(x)
            self.places[:, self.known] = [np.packbits(p) for p in (v[self.rho][self.rho], v[self.rho], v)]
            self.row[x], self.known = self.known, self.known + 1
        return self.row[letters]

    def _trigrams(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct trigrams and how often each occurs, a segment of the text at a time."""
        tail = np.zeros(1, np.int64)
        for i in range(0, len(text), SEGMENT):
            part = self.table[np.frombuffer(text[i : i + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)]
            s = np.concatenate([tail, part, np.zeros(int(i + SEGMENT >= len(text)), np.int64)])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # blanks between words count once
            if len(s) > 2:
                yield np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)
            tail = s[-2:]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a whole text; None if it has no letter."""
        out, total, one = np.zeros(self.dimensions), 0, (1 << 21) - 1
        for codes, counts in self._trigrams(text or ""):
            first, second, third = (self.places[i, r] for i, r in enumerate([self._rows(codes >> 42), self._rows(codes >> 21 & one), self._rows(codes & one)]))
            for at in range(0, len(codes), 4096):
                some = slice(at, at + 4096)
                bound = np.unpackbits(first[some] ^ second[some] ^ third[some], axis=1)
                out -= 2 * (counts[some].astype(np.float32) @ bound.astype(np.float32))
            total += int(counts.sum())
        if not total:
            return None
        out += total
        norm = float(np.sqrt(out @ out))
        return (out / norm if norm else out).astype(np.float32)


_SPACE: list[Space] = []


def _space() -> Space:
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def sample(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` usable labelled documents of each language."""
    keyed = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    h = F.xxhash64("doc_id")
    picked = materialize(
        keyed.select("doc_id", "lang", h.alias("h"))
        .groupBy("lang", F.pmod("h", F.lit(per_language)).alias("bucket"))
        .agg(F.min(F.struct("h", "doc_id")).alias("least"))
        .select(F.col("least.doc_id").alias("doc_id"), "lang"),
        "sample",
    )
    if picked.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    return keyed.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi").select("lang", "text")


def train(examples: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes; tasks return one partial sum for each language they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _space(), {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if (v := space.bundle(text.as_py())) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(float)
        langs = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))], names=["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for row in examples.repartition(8).mapInArrow(run, "lang string, v array<double>").sort("lang").toLocalIterator():
        total[row.lang] = total.get(row.lang, 0) + np.array(row.v)
    return {lang: v / (np.sqrt(v @ v) or 1.0) for lang, v in total.items()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str] | None = None, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score (the cosine, 0 to 1).

    ``added`` names the two columns; columns of these names that were there are replaced. Only ``text`` is looked at; a text that is not kept does not come back from Python.
    """
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs], np.float32) if langs else None
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    given = names if "text" in names else [*names, "text"]
    at, n = given.index("text"), len(names)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.unload()
        space = _space()
        for b in batches:
            said, scores = [], []
            for text in b.column(at):
                v = None if matrix is None else space.bundle(text.as_py())
                if v is None:
                    said.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    cosines = matrix @ v
                    k = int(cosines.argmax())
                    said.append(langs[k])
                    scores.append(round(min(1.0, max(0.0, float(cosines[k]))), 6))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*names, *added])

    return docs.select(*given).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, usable: Column | None = None, keep: list[str] | None = None, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Train on the labelled documents for which ``usable`` holds, then predict all of ``docs``."""
    return predict(docs, train(sample(docs, F.lit(True) if usable is None else usable)), keep, added)
