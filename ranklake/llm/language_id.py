"""Language ID: the language whose dictionary compresses a text best.

For each language a zstandard raw-content dictionary is filled by at most ``SAMPLE`` labelled rows, by hash order: a
bounded sample.  Each row gives an equal share, in pieces of at most ``PIECE`` characters spread over its whole text.  A
dictionary has ``DICT_BYTES``, or less where there are so many languages that all together would exceed
``MODEL_BYTES``; so every language has one, and all are small enough for every task.  A text is brought to lower-case words and cut into
``CHUNK`` byte pieces, all of it; each piece is compressed with each dictionary, and the language with
the smallest sum wins.  Where the runner-up is within ``MIN_MARGIN`` of it, the text is rejected.

Nothing is shuffled but the sample.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language
with more labelled rows in the sample, then to the first by name; without labelled rows all is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.blocks import ALNUM, blocks, joined_words, words

UNDETERMINED = "und"
SAMPLE = 60
DICT_BYTES = 64 * 1024
MODEL_BYTES = 16 << 20
PIECE = 128
CHUNK = 512
LEVEL = 6
MIN_MARGIN = 0.01
#: Bytes of difference per unit of log-odds in the score.
SCALE = 4.0


def _normalised(texts: list[bytes]) -> list[bytes]:
    """Lower-case words joined by blanks."""
    column = pa.array([t.decode("utf-8", "replace").lower().encode() for t in texts], pa.binary())
    return [t for b in blocks(column) for t in joined_words(b, words(b, ALNUM, hashed=False), ALNUM)]


def fit(docs: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) in order of the sample's rows, from rows that are ``usable``.

    At most ``SAMPLE`` rows of a language reach the driver, and of these no more than the dictionary takes.
    """
    known = docs.filter(usable & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(id, text).alias("order"), F.col(text).alias("text")
    )
    by = Window.partitionBy("lang").orderBy("order", F.xxhash64("text"))
    ranked = known.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= SAMPLE)
    languages = known.agg(F.count_distinct("lang")).first()[0]
    size = max(PIECE, min(DICT_BYTES, MODEL_BYTES // max(1, languages)))
    rows_of = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    share = F.floor(F.lit(size) / rows_of).cast("int")
    rows = ranked.withColumn("share", share).select("lang", "rn", _spread("text", "share").alias("text")).orderBy("rn", "lang").collect()
    by_lang: dict[str, list[bytes]] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r["text"].encode())
    made = []
    for name, texts in sorted(by_lang.items(), key=lambda x: (-len(x[1]), x[0])):
        # A share is counted in bytes with the blank that follows it.
        own = size // len(texts) - 1
        made.append((name, b" ".join(t[:own] for t in _normalised(texts))))
    return made


def _spread(text: str, share: str) -> Column:
    """About ``share`` characters of a text, in pieces spread evenly from its beginning to its end."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col(share) / PIECE)).cast("int")
    length = F.floor(F.col(share) / pieces).cast("int")
    last = F.length(text) - length
    starts = F.transform(F.sequence(F.lit(0), pieces - 1), lambda k: (F.lit(1) + k * last / F.greatest(F.lit(1), pieces - 1)).cast("int"))
    cut = F.array_join(F.transform(starts, lambda at: F.substring(F.col(text), at, length)), " ")
    return F.when(F.length(text) <= F.col(share), F.col(text)).otherwise(cut)


class Compressors:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        import zstandard as z

        self.names = [n for n, _ in dictionaries]
        self.of = []
        for _, content in dictionaries:
            d = z.ZstdCompressionDict(content.rjust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.of.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes, chunk: int = CHUNK) -> list[int]:
        pieces = [text[i : i + chunk] for i in range(0, len(text), chunk)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.of]


def decide(names: list[str], sizes: list[int]) -> tuple[str, float, float]:
    """(language, score, margin): the smallest, its weight among all, and the runner-up's excess."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    best = sizes[order[0]]
    score = 1 / sum(np.exp((best - s) / SCALE) for s in sizes)
    margin = (sizes[order[1]] - best) / max(1, best) if len(order) > 1 else 1.0
    return names[order[0]], float(score), float(margin)


def _predictor(dictionaries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        compressors = Compressors(dictionaries)
        for batch in batches:
            own = batch.drop_columns(["_text"])
            for block in blocks(batch.column("_text")):
                texts = [block.text(i) for i in range(block.hi - block.lo)]
                out = []
                for raw, text in zip(texts, _normalised(texts)):
                    if not dictionaries or not letter.search(raw.decode("utf-8", "replace")):
                        out.append((UNDETERMINED, 0.0, 0.0))
                    else:
                        out.append(decide(compressors.names, compressors.sizes(text)))
                lang, score, margin = zip(*out)
                rows = own.slice(block.lo, block.hi - block.lo)
                columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*own.schema.names, "best", "score", "margin"])

    return run


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang (``und`` where rejected), best (the nearest language), score, margin."""
    source = docs.select(F.col(id), F.col(text).cast("binary").alias("_text"))
    kind = source.schema[id].dataType.simpleString()
    found = source.mapInArrow(_predictor(dictionaries), f"{id} {kind}, best string, score double, margin double")
    lang = F.when(F.col("margin") >= MIN_MARGIN, F.col("best")).otherwise(UNDETERMINED)
    return found.select(id, lang.alias("lang"), "best", "score", "margin")
