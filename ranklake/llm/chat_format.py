"""Chat formatting: conversations as turn-aligned windows within a token budget, with a loss mask.

Prefix sums of turn tokens choose the windows.  With ``fresh`` tokens per window for new turns, a turn
that lies in one cell of that many tokens joins the cell's window, and a turn that crosses into the
next cell is a window of its own; so a window depends on prefix sums only and is found for all
conversations at once, whatever their length.  Each window repeats the conversation's leading system
turn, then the last turns before it of up to ``history`` tokens in all, then its new turns.  History
gives way: it takes at most what the system turn and the new turns leave of the budget.  Only new
assistant turns are under the loss mask; repeated ones are not, so each is a target once.

Turns are sorted by range over all conversations, so a long one is spread over many tasks.  Running
sums within a range are completed by the totals of the ranges before it, at most one per range.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a role or text are escaped
by ``\\_`` after their first character, backslashes by doubling; ``unescape`` reverses both.

Defined cases: null texts and roles are empty; a null turn comes first; ties go by role, then a hash of the text; a
null conv_id is a conversation; a conversation of only a system turn is one window; a single turn
that exceeds the budget together with the system turn is a window without history that is flagged, and no other is; no
rows give no windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.packing import _encode_words
from ranklake.sources.storage import stored

BUDGET = 1024
HISTORY = 256

#: Control strings of the template and of other common templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
START, END = CONTROLS[:2]

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\_n])")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\_" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "_": "", "n": "\n"}[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, what stands after it."""
    return START + escape(role).replace("\n", "\\n") + "\n", escape(text), END + "\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _running(path: str):
    """Adds tokens, and per conversation the tokens before each turn, within a sorted range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = _encode_words(path), TaskContext.get().partitionId(), 0
        last, before = object(), 0
        for batch in batches:
            columns = batch.to_pydict()
            turns = [format_turn(r, t) for r, t in zip(columns["role"], columns["text"])]
            tokens = [len(x) for x in encode(["".join(t) for t in turns])]
            out = {"tokens": tokens, "before": [], "lead": [], "part": [part] * len(tokens), "at": []}
            for conv, role, n in zip(columns["conv_id"], columns["role"], tokens):
                lead = conv != last and role == "system"
                if conv != last:
                    last, before = conv, 0
                out["lead"].append(lead)
                out["before"].append(before)
                out["at"].append(number)
                number += 1
                before += 0 if lead else n
            made = pa.RecordBatch.from_pydict(
                {k: pa.array(v, {"lead": pa.bool_(), "part": pa.int32()}.get(k, pa.int64())) for k, v in out.items()}
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "role", "text")] + made.columns,
                names=["conv_id", "role", "text", *made.schema.names],
            )

    return run


_ROWS = "conv_id long, role string, text string, tokens long, before long, lead boolean, part int, at long"


def _placed(turns: DataFrame, path: str, budget: int, history: int) -> DataFrame:
    """Each turn with the tokens before it in its conversation, its window, and whether it leads."""
    source = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = ["conv_id", "turn", "role", F.xxhash64("text")]
    ranged = source.repartitionByRange(*key).sortWithinPartitions(*key, "text")
    rows = stored(ranged.select("conv_id", "role", "text").mapInArrow(_running(path), _ROWS), "turns")
    span = Window.partitionBy("conv_id").orderBy("part")
    totals = (
        rows.groupBy("conv_id", "part")
        .agg(
            F.sum(F.when(F.col("lead"), 0).otherwise(F.col("tokens"))).alias("own"),
            F.max(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).alias("led"),
        )
        .withColumn("first", F.min("part").over(Window.partitionBy("conv_id")) == F.col("part"))
        # A range that continues a conversation has no leading turn, whatever its first row is.
        .withColumn("all", F.col("own") + F.when(F.col("first"), 0).otherwise(F.col("led")))
        .withColumn("carry", F.coalesce(F.sum("all").over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("system", F.first(F.col("led")).over(span))
        .select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "first", "led", "carry", "system")
    )
    joined = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    shifted = F.when(F.col("first") | F.col("lead"), 0).otherwise(F.col("led"))
    # Cells shrink for a long system turn, to a quarter of the budget and then to what it leaves.
    room = F.lit(budget) - F.col("system")
    fresh = F.greatest(room - history, F.least(room, F.lit(budget // 4)), F.lit(1))
    placed = joined.select(
        "conv_id", "role", "text", "tokens", "part", "at", "system",
        (F.col("lead") & F.col("first")).alias("lead"),
        (F.col("carry") + F.col("before") + shifted).alias("before"),
        fresh.alias("fresh"),
        F.greatest(F.least(room, F.lit(history)), F.lit(0)).alias("past"),
    )
    cell = F.expr("before div fresh")
    crosses = F.expr("(before + tokens - 1) div fresh") > cell
    return placed.withColumn("window", F.when(F.col("lead"), -1).otherwise(2 * cell + crosses.cast("long")))


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window of ``turns`` (conv_id, turn, role, text).

    conv_id, window (ascending), n_system, n_history, n_new, n_tokens, over_budget, text, and loss: the
    spans of code points of ``text`` that are targets.
    """
    placed = stored(_placed(turns, path, budget, history), "placed")
    new, lead = placed.filter(~F.col("lead")), placed.filter("lead")
    left = F.lit(budget) - F.max("system") - F.sum("tokens")
    made = new.groupBy("conv_id", "window").agg(F.min("before").alias("begins"), F.least(left, F.lit(history)).alias("room"))
    alone = lead.join(new.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    none = F.lit(0).cast("long")
    made = made.unionByName(alone.select("conv_id", none.alias("window"), none.alias("begins"), none.alias("room")))
    content = ["conv_id", "window", "kind", "part", "at", "role", "text", "tokens"]
    fresh = new.withColumn("kind", F.lit(2))
    # A turn may be history of the few windows that begin within `past` tokens after it began: a cell is no shorter.
    reach = F.expr("2 * ((before + past) div fresh) + 1")
    later = new.select(
        F.col("conv_id").alias("_c"), "part", "at", "role", "text", "tokens", "before", "window", reach.alias("reach")
    ).filter(F.col("reach") > F.col("window"))
    later = later.withColumn("_w", F.explode(F.sequence(F.col("window") + 1, F.col("reach")))).drop("window")
    past = (
        made.join(later, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("window") == F.col("_w")))
        .filter(F.col("begins") - F.col("before") <= F.col("room"))
        .withColumn("kind", F.lit(1))
    )
    system = made.join(
        lead.select(F.col("conv_id").alias("_c"), "part", "at", "role", "text", "tokens"), F.col("conv_id").eqNullSafe(F.col("_c"))
    ).withColumn("kind", F.lit(0))
    every = fresh.select(*content).unionByName(past.select(*content)).unionByName(system.select(*content))
    ordered = every.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "kind", "part", "at")
    return ordered.mapInArrow(_assembler(budget), _WINDOWS)


_WINDOWS = (
    "conv_id long, window long, n_system long, n_history long, n_new long, n_tokens long, over_budget boolean, "
    "text string, loss array<struct<start:long,end:long>>"
)
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("n_system", pa.int64()), ("n_history", pa.int64()), ("n_new", pa.int64()),
    ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def _assembler(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        held: list[tuple] = []
        key = None

        def close() -> None:
            text, at, loss, kinds = [], 0, [], [0, 0, 0]
            for kind, role, body, _ in held:
                head, escaped, tail = format_turn(role, body)
                if kind == 2 and role == "assistant":
                    loss.append({"start": at + len(head), "end": at + len(head) + len(escaped)})
                text += [head, escaped, tail]
                at += len(head) + len(escaped) + len(tail)
                kinds[kind] += 1
            tokens = sum(h[3] for h in held)
            done.append(dict(zip(_SCHEMA.names, (*key, *kinds, tokens, tokens > budget, "".join(text), loss))))

        for batch in batches:
            c = batch.to_pydict()
            for conv, window, *row in zip(c["conv_id"], c["window"], c["kind"], c["role"], c["text"], c["tokens"]):
                if (conv, window) != key:
                    if held:
                        close()
                    key, held = (conv, window), []
                held.append(tuple(row))
            if len(done) >= 500:
                yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)
                done = []
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)

    return run
