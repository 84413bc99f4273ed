"""Fill-in-the-middle against plain Python."""

import hashlib
import random
import re

import numpy as np

from ranklake.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
DOCS = "doc_id long, text string, form string, n string"


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 40, 700, 5000):
        widths = rng.integers(1, 9, n).astype(np.int32)
        units = fill_middle.SkipList(widths)
        ends = np.concatenate(([0], np.cumsum(widths)))
        assert [units.locate(r) for r in range(n + 1)] == ends.tolist()
    assert len(units.lanes) >= 5
    # Lanes thin out, also where their coins repeat: no lane is walked for long.
    long = fill_middle.SkipList(np.ones(300_000, np.int32))
    assert [long.locate(r) for r in (0, 1, 65_536, 299_999, 300_000)] == [0, 1, 65_536, 299_999, 300_000]
    assert all(units is None or units.max() < 80 * 5**k for k, (_, units, _) in enumerate(long.lanes))


def test_units_across_pieces(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 5)
    r = random.Random(5)
    texts = ["".join(r.choice("abZ 1\né漢😀") for _ in range(r.randint(0, 40))) for _ in range(200)] + ["", ""]
    raw = [t.encode() for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    widths, firsts = fill_middle.unit_widths(np.frombuffer(b"".join(raw), np.uint8), begins)
    got = [widths[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])]
    assert got == [[len(u) for u in UNIT.findall(t)] for t in texts]


def test_outputs_and_texts_rebuilt(spark):
    r = random.Random(6)
    texts = [None, "", "a", "é", "😀😀", "has <P> in it", "<S>", "ends with <", "<M", "P>x<", "long " * 60_000, "x" * 200_000, "\x00 nul", "two\r\nlines"]
    texts += ["".join(r.choice(["ab", "Z", " ", "<", "P>", "S>", "M>", "é", "\n", "😀"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id here", "c", "c"), (7, "same id", "c", "c"), (7, "same id", "c", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    made = fill_middle.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.select("*", fill_middle.restore(made["output"], made["form"]).alias("back")).collect()
    assert len(back) == len(rows)
    for row in back:
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == brute(row["doc_id"], row["text"])
        assert row["back"] == (row["text"] or "")
    assert {row["form"] for row in back} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0
