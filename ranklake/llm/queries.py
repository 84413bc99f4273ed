"""The registered queries of the thirteen operators: each applies its operator to the whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import byte_bpe, chat_format, decontaminate, fill_middle, language_id, license_scan, line_dedup, ngram_join, packing, prefix_trie, quality_cnn, spotsigs, url_filter
from ranklake.llm.neighbours import with_next
from ranklake.sources.storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer's file lies, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(id: Column, folds: int) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds


@register
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents hold of benchmark items: one row per (doc_id, item_id)."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# -- chat formatting ---------------------------------------------------------

_CHAT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their windows, sorted by conversation and window; texts are not gathered."""
    key, state, rows = object(), None, []

    def close() -> None:
        if state:
            rows.append((key, state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"], state["windows"]))

    for batch in batches:
        c = batch.to_pydict()
        for conv, system, history, text, loss in zip(*(c[k] for k in ("conv_id", "n_system", "n_history", "text", "loss"))):
            if state is None or conv != key:
                close()
                key = conv
                state = {"turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0, "windows": 0}
            # Later windows begin with what was there before.
            for role, body in chat_format.parse(text)[system + history if state["windows"] else 0 :]:
                state["turns"] += 1
                state["all"].update(f"{role}\n{body}\n".encode())
            for span in loss:
                target = chat_format.unescape(text[span["start"] : span["end"]])
                state["loss"] += len(target)
                state["masked"].update(target.encode())
            state["chars"] += len(text)
            state["windows"] += 1
        if len(rows) > 2000:
            yield _rows(rows, _CHAT)
            rows.clear()
    close()
    if rows:
        yield _rows(rows, _CHAT)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


@register
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted windows."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    made = chat_format.windows(turns.unionByName(tricky), tokenizer_path())
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "n_system", "n_history", "text", "loss").mapInArrow(_read_back, _CHAT)


# -- fingerprints ------------------------------------------------------------

_PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def _fingerprint_pairs(ids: list, texts: list[bytes], following: list[bytes]) -> pa.RecordBatch:
    edited = []
    chars = [t.decode("utf-8", "replace") for t in texts]
    after = [t.decode("utf-8", "replace") for t in following]
    for own, other in zip(chars, after):
        half = len(own) // 2
        edited.append((own[: len(own) - half] + other[:half]).encode())
    sets = spotsigs.sets_of_texts(texts + following[-1:])
    changed = spotsigs.sets_of_texts(edited)
    rows = [
        (i, len(own), hashlib.sha256(e).hexdigest(), spotsigs.encode(s), spotsigs.encode(c), spotsigs.likeness(s, c), spotsigs.likeness(s, n), len(s))
        for i, own, e, s, c, n in zip(ids, chars, edited, sets, changed, sets[1:])
    ]
    return _rows(rows, _PRINTS)


@register
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, and how alike they are."""
    return with_next(_table(spark, sf_dir, "documents"), _fingerprint_pairs, _PRINTS)


# -- n-gram join -------------------------------------------------------------


@register
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

ORACLES["op4_ngram_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM w
), e AS (
  SELECT doc_id, len(g) AS n, unnest([hash(x) FOR x IN g]) AS g FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT s.doc_id, len(s.g) AS n_shingles, min(reach.r) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, len(s.g)
"""


# -- URL filter --------------------------------------------------------------


@register
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


# -- classifiers -------------------------------------------------------------


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_cnn.fit(docs, labels, _fold(F.col("doc_id"), 3) != 1)
    return quality_cnn.score(docs, model).select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@register
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest language of each document, also where the operator would reject it (``rejected``)."""
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language_id.fit(docs, _fold(F.col("doc_id"), 4) != 2)
    return language_id.identify(docs, dictionaries).select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("best").alias("lang_pred"),
        "score",
        (F.col("lang") == language_id.UNDETERMINED).alias("rejected"),
    )


# -- line dedup --------------------------------------------------------------


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


ORACLES["op8_line_dedup"] = """
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), trimmed AS (
  SELECT doc_id, line, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM parts
), placed AS (
  SELECT *, count(*) FILTER (t <> '') OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM trimmed
), spans AS (
  SELECT doc_id, k, t AS a, lead(t) OVER o AS b, lead(t, 2) OVER o AS c, count(*) OVER (PARTITION BY doc_id) AS filled
  FROM placed WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  -- A document of one or two lines is a window of all its lines.
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS r FROM spans
    WHERE c IS NOT NULL OR (filled < 3 AND k = 1)) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, k + d AS k, true AS gone FROM later, (VALUES (0), (1), (2)) AS v(d)
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gone IS NULL), '')) AS text_sha256
FROM placed LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
"""


# -- packing, licenses -------------------------------------------------------


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@register
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text").withColumn("spans", F.to_json("spans"))


# -- fill in the middle ------------------------------------------------------


@register
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' infilling outputs, and of the texts rebuilt from these."""
    made = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


ORACLES["op11_fill_middle"] = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
    [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS k FROM t
), c AS (
  SELECT *, len(w) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS b FROM u
), p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(w[b + 1:], ''), '') AS suf,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
      WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


# -- byte-level BPE ----------------------------------------------------------


@register
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of the texts decoded from these."""
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(coded.drop("text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_replaced",
    )


# -- conversation prefix trie ------------------------------------------------


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its twenty: h = crc32(id) % 4."""
    h = F.coalesce((F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"), F.lit(0))
    none = F.array().cast(prefix_trie.PATH)
    heads = own.select(F.col("conv_id").alias("_first"), F.slice("path", 1, 3).alias("_head"))
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("_first"), "left")
    head = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("path", h + 1, F.size("path"))).alias("path"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    own = stored(prefix_trie.paths(_table(spark, sf_dir, "conversations")), "own")
    return prefix_trie.nodes(rebuilt(own))


ORACLES["op13_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), k AS (
  SELECT conv_id, turn, role, sha256(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM t
), own AS (
  SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, role, k) AS p FROM k GROUP BY conv_id
), c AS (
  SELECT *, coalesce(xor(list_reduce(flatten([[ord(x), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: xor(xor(a, b) // 2, (xor(a, b) % 2) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295) % 4, 0) AS h FROM own
), r AS (
  SELECT c.conv_id, list_concat(coalesce(f.p, [])[1:h], c.p[h + 1:]) AS p FROM c LEFT JOIN own AS f ON f.conv_id = c.conv_id - c.conv_id % 20
), m AS (
  SELECT conv_id, len(p) AS len, unnest([{'d': d, 'path': [array_to_string([x.k FOR x IN p[1:i]], '') FOR i IN range(0, d + 1)], 'w': CASE WHEN d > 0 THEN p[d].w ELSE 0 END}
    FOR d IN range(0, len(p) + 1)]) AS n FROM r
), n AS (
  SELECT n.path AS path, any_value(n.d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n.w) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n.d = len), '')) AS ends_sha256 FROM m GROUP BY n.path
), kids AS (
  SELECT path[1:depth] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), j AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.path
), s AS (
  SELECT up, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT own, n_children, unnest([path[1:i] FOR i IN range(1, depth + 2)]) AS up FROM j) GROUP BY up
)
SELECT j.conv_id, j.depth, f.conv_id AS parent_conv_id, j.n_convs, j.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, j.ends_sha256
FROM j JOIN s ON s.up = j.path LEFT JOIN n AS f ON j.depth > 0 AND f.path = j.path[1:j.depth]
"""
