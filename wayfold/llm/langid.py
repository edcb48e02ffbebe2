"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from its code point. An n-gram of
letters is the product (binding) of its letters' vectors, each rotated by its
place; a text is the sum (bundle) of its n-grams' vectors; a language is the
bundle of its training texts. A text goes to the language with the largest
cosine. Runs of anything but letters count as one blank.

Training takes about ``per_language`` texts of each language, chosen by id
hash against the language's count; that is the documented bound. Partial
bundles are summed in the cluster, so the driver sees one vector a language.

Null texts and texts without letters give ``und`` with score 0, and ties go to
the smaller name. No training text at all makes every answer ``und``. Repeated
rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
PER_LANGUAGE = 2_000
CACHE_GRAMS = 1 << 15
#: N-grams handled at once, which bounds memory on very long texts.
BLOCK = 1 << 18


class Hypervectors:
    """Deterministic letter vectors and the bundles built of them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, object] = {}
        self.rows: dict[int, int] = {}
        self.table = None

    def letter(self, code: int):
        import numpy as np

        if code not in self.letters:
            drawn = np.random.Generator(np.random.Philox(key=(self.seed << 32) | code)).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = 2 * drawn - 1
        return self.letters[code]

    def gram(self, packed: int):
        import numpy as np

        out = np.ones(self.dimensions, dtype=np.int8)
        for place in range(GRAM):
            out *= np.roll(self.letter((packed >> (21 * place)) & 0x1FFFFF), place)
        return out

    def counts(self, text: str):
        """Packed n-grams of a text and their counts."""
        import numpy as np

        spaced = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else None
        if spaced is None:
            raw = np.frombuffer(text.lower().encode("ascii"), dtype=np.uint8)
            codes = np.where((raw >= 97) & (raw <= 122), raw, 32).astype(np.int64)
        else:
            codes = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        codes = np.concatenate(([32], codes, [32]))
        codes = codes[(codes != 32) | np.concatenate(([True], codes[:-1] != 32))]
        if len(codes) < GRAM:
            return None
        packed = codes[: len(codes) - GRAM + 1].copy()
        for place in range(1, GRAM):
            packed |= codes[place : len(codes) - GRAM + 1 + place] << (21 * place)
        return np.unique(packed, return_counts=True)

    def bundle(self, text: str | None):
        """Float vector of a text, None without letters."""
        import numpy as np

        found = self.counts(text) if text else None
        if found is None:
            return None
        out = np.zeros(self.dimensions, dtype=np.float64)
        grams, times = found
        for begin in range(0, len(grams), 4096):
            part = grams[begin : begin + 4096].tolist()
            if self.table is None or len(self.rows) + len(part) > CACHE_GRAMS:
                self.rows, self.table = {}, np.empty((CACHE_GRAMS, self.dimensions), dtype=np.int8)
            for g in part:
                if g not in self.rows:
                    self.table[len(self.rows)] = self.gram(g)
                    self.rows[g] = len(self.rows)
            index = np.fromiter((self.rows[g] for g in part), dtype=np.int64, count=len(part))
            out += times[begin : begin + 4096].astype(np.float32) @ self.table[index].astype(np.float32)
        return out


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict[str, list[float]]:
    """Language prototypes from the rows where training holds and the language is known."""
    import numpy as np

    known = docs.where(training & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    size = known.groupBy(F.col("__lang").alias("__l")).agg(F.count("*").alias("__n"))
    share = F.pmod(F.xxhash64(F.lit("profile"), F.col("__id")), F.lit(1 << 30)).cast("double") * F.col("__n") < F.lit(float(per_language << 30))
    chosen = known.join(F.broadcast(size), F.col("__lang") == F.col("__l")).where(share).select("__lang", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Hypervectors(), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = space.bundle(text.as_py())
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + vector
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "bundle"])

    parts = chosen.mapInArrow(run, "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("i", "x"))
    whole = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    model = {}
    for row in whole.collect():
        vector = np.array([p.x for p in row.v])
        if (length := np.linalg.norm(vector)) > 0:
            model[row.lang] = (vector / length).tolist()
    return dict(sorted(model.items()))


def identify(docs: DataFrame, model: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    names, kind = list(model), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        space, prototypes = Hypervectors(), np.array([model[n] for n in names])
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                vector = space.bundle(text.as_py()) if names else None
                length = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not length:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosine = prototypes @ vector / length
                best = int(cosine.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosine[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
