"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ranklake.llm import blocks as B
from ranklake.llm import chat_format, decontaminate, language_id, license_scan, line_dedup, ngram_join, packing, quality_cnn, queries, spotsigs, url_filter

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A_Z = {i: i + 32 for i in range(65, 91)}
EDGES = [None, "", " \n\t", "!!! ???", "one", "ONE two", "a b c d e", "é à ß", "x" * 30_000, "word " * 9_000]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_words_match_the_patterns():
    texts = [t or "" for t in EDGES] + ["Ab,cd-9é", "tail ", " lead"]
    for kind, pattern in ((B.SPACED, r"[^\x20\x09-\x0D]+"), (B.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for b in B.blocks(pa.array([t.encode() for t in texts]), 64):
            found = B.words(b, kind)
            for k, t in enumerate(texts[b.lo : b.hi]):
                want = re.findall(pattern, t.translate(A_Z))
                assert [B.word_hash(w) for w in want] == found.hash[found.first[k] : found.first[k + 1]].tolist()


# -- 1 -----------------------------------------------------------------------


def test_block_max_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = int(rng.integers(1, 60)), int(rng.integers(2, 40))
        item, term = np.nonzero(rng.random((n, m)) < 0.3)
        if not len(item):
            continue
        weight = rng.random(len(item)) + 0.01
        index = decontaminate.BlockMaxIndex(item, term.astype(np.uint64), weight, n, block=3)
        dense = np.zeros((n, m))
        dense[item, term] = weight / np.bincount(item, weights=weight, minlength=n)[item]
        query = sorted({int(x) for x in rng.integers(0, len(index.terms), 9)})
        scores = dense[:, index.terms[query].astype(int)].sum(1)
        assert dict(index.search(query, 0.3)).keys() == set(np.flatnonzero(scores >= 0.3).tolist())


def test_contaminated(spark):
    item = prose(40, 5)
    docs = docs_of(spark, [*EDGES, prose(200, 6), prose(90, 7) + " " + item.upper() + " " + prose(300, 8), " ".join(item.split()[:12]), item])
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, prose(30, 9))], "item_id long, text string")
    found = decontaminate.contaminated(docs.withColumn("item_id", docs.doc_id), items).collect()
    n = len(EDGES)
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(n + 1, 7), (n + 3, 7)}
    clean = decontaminate.decontaminate(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == set(range(n + 4)) - {n + 1, n + 3} and clean.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


# -- 2 -----------------------------------------------------------------------


def test_escape_is_reversible():
    r = random.Random(3)
    parts = [*chat_format.CONTROLS, "\\", "_", "\\_", "\\n", "\n", "a", "<", "|", "é"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(c in escaped for c in chat_format.CONTROLS)


def test_windows_read_back(spark):
    r = random.Random(4)
    rows = [(1, i, ["user", "assistant"][i % 2], prose(r.randint(0, 60), i)) for i in range(300)]
    rows += [(2, 0, "system", "be brief"), (2, 1, "user", None), (2, 2, "assistant", "x " * 900), (2, 3, "user", "</s>"), (3, 0, "system", "only"), (None, 1, None, "t"), (None, 0, "assistant", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.windows(turns, queries.tokenizer_path(), budget=256, history=64)
    by_conv = defaultdict(list)
    for w in windows.orderBy("conv_id", "window").collect():
        by_conv[w["conv_id"]].append(w)
    for conv, own in by_conv.items():
        want = [(role or "", text or "") for c, _, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) if c == conv]
        turns_read, targets = [], []
        for k, w in enumerate(own):
            read = chat_format.parse(w["text"])
            assert len(read) == w["n_system"] + w["n_history"] + w["n_new"]
            assert w["over_budget"] == (w["n_tokens"] > 256)
            assert not w["over_budget"] or w["n_history"] == 0 and w["n_new"] == 1
            assert w["n_history"] == 0 or k
            turns_read += read[w["n_system"] + w["n_history"] if k else 0 :]
            targets += [chat_format.unescape(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
        assert turns_read == want
        assert targets == [t for role, t in want if role == "assistant"]
    assert all(w["n_system"] == 1 for w in by_conv[2]) and len(by_conv[2]) > 1 and len(by_conv[1]) > 20
    assert sum(w["n_history"] for w in by_conv[1]) > 0
    assert chat_format.windows(turns.limit(0), queries.tokenizer_path()).count() == 0


def test_history_gives_way(spark):
    words = lambda n: " ".join(["the"] * n)
    rows = [(1, i, "user", words(60)) for i in range(6)] + [(1, 6, "assistant", words(890))] + [(1, 7 + i, "user", words(60)) for i in range(6)]
    for conv, size in ((2, 690), (3, 900), (4, 1015), (5, 2000)):
        rows += [(conv, 0, "system", words(size))] + [(conv, i, ["user", "assistant"][i % 2], words(20 + 7 * i % 40)) for i in range(1, 60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(turns, queries.tokenizer_path()).collect()
    for w in made:
        assert w["over_budget"] == (w["n_tokens"] > 1024)
        # Over the budget is only a turn that exceeds it together with the system turn.
        assert not w["over_budget"] or w["conv_id"] >= 4 and w["n_new"] == 1 and w["n_history"] == 0
        assert w["conv_id"] != 5 or w["over_budget"]
    (long,) = [w for w in made if w["conv_id"] == 1 and w["n_tokens"] > 900]
    assert long["n_new"] == 1 and long["n_history"] == 1
    assert all(sum(w["n_new"] for w in made if w["conv_id"] == c) == 59 for c in (2, 3, 4, 5))
    assert any(w["n_history"] for w in made if w["conv_id"] == 2)


@needs_tables
def test_op2_digests(spark):
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, SF_DIR).collect()}
    own = defaultdict(list)
    for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own[r["conv_id"]].append((r["role"], r["text"] or ""))
    own[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == own.keys()
    for conv, turns in own.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# -- 3 -----------------------------------------------------------------------


def test_fingerprints(spark):
    base = "the cat sat on the mat and the dog ran to the big house of an old man " * 3
    texts = [*EDGES, base, base, base.replace("house", "barn"), prose(50, 1)]
    rows = {r["doc_id"]: r for r in spotsigs.fingerprint(docs_of(spark, texts)).collect()}
    n = len(EDGES)
    assert rows[n]["fingerprint"] == rows[n + 1]["fingerprint"] and rows[0]["fingerprint"] == rows[1]["fingerprint"] == ""
    assert rows[n + 3]["n_signatures"] > 0
    for r in rows.values():
        assert spotsigs.decode(r["fingerprint"]).astype(np.int64).tolist() == r["signatures"]
    pairs = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.matches(spotsigs.fingerprint(docs_of(spark, texts)), 0.6).collect()}
    classes = sorted({r["fingerprint"] for r in rows.values()} - {""})
    want = {}
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            like = spotsigs.likeness(spotsigs.decode(a), spotsigs.decode(b))
            if like >= 0.6:
                want[a, b] = like
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-9 for k in want) and want


def test_spotsigs_query_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ranklake.llm.neighbours.BUCKET_ROWS", 3)
    texts = ["the cat sat é", None, "a dog", "the cat sat é of the day", "", prose(40, 2), "zz"] * 3
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_spotsigs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own, following = t or "", texts[i - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = spotsigs.sets_of_texts([x.encode() for x in (own, edited, following)])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(own)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (spotsigs.encode(a), spotsigs.encode(b))
        assert (got[i]["near_edited"], got[i]["near_next"]) == (spotsigs.likeness(a, b), spotsigs.likeness(a, c))


# -- 4 -----------------------------------------------------------------------


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(A_Z))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


def test_odd_sketches_bound_the_difference():
    r = random.Random(12)
    for _ in range(60):
        x = np.unique(np.array([r.getrandbits(64) for _ in range(r.randint(1, 9000))], np.uint64))
        y = np.unique(np.concatenate((x[r.randint(0, len(x)) :], np.array([r.getrandbits(64) for _ in range(r.randint(0, 900))], np.uint64))))
        a, b = ngram_join._sketches([x, y]).to_pylist()
        bits = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(a, b))
        assert 0 <= bits <= len(np.setxor1d(x, y)) and len(a) == ngram_join.BITS // 64


def test_a_passage_that_many_unlike_documents_share(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    shared = prose(12, 99)
    texts = [f"{prose(25, i)} {shared} {prose(25, 1000 + i)}" for i in range(260)]
    texts += [t + " more" for t in texts[:20]] + [texts[3], texts[4].upper()]
    emitted = []
    prune = ngram_join._sets_apart

    def counted(sets, pairs, percent):
        made = prune(sets, pairs, percent)
        emitted.append(made.count())
        return made

    monkeypatch.setattr(ngram_join, "_sets_apart", counted)
    got = [tuple(x) for x in ngram_join.jaccard_components(docs_of(spark, texts), sketch_bits=12).orderBy("doc_id").collect()]
    assert got == brute_components(texts)
    assert sum(emitted) < 200  # of 33,000 pairs that share the passage


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 4)
    r = random.Random(8)
    base, texts = prose(80, 1).split(), list(EDGES)
    shared = prose(30, 2)
    for k in range(30):
        words = list(base)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"new{r.randrange(99)}"
        texts += [" ".join(words), prose(60, 100 + k) + " " + shared]
    texts += [" ".join(base), " ".join(base).upper(), "a  b c\td E", "ONE  two"]
    got = [tuple(x) for x in ngram_join.jaccard_components(docs_of(spark, texts), sketch_bits=12).orderBy("doc_id").collect()]
    assert got == brute_components(texts)
    assert ngram_join.jaccard_components(docs_of(spark, texts).limit(0), sketch_bits=12).count() == 0


def test_near_duplicates_tell_texts_of_one_id_apart(spark):
    x, y, z = prose(60, 31), prose(60, 32), prose(60, 33)
    near, near_z = x + " end", z + " end"
    rows = [(3, x), (5, near), (5, y), (5, y), (None, z), (None, near_z), (None, z), (None, x), (None, prose(60, 34)), (6, None), (6, ""), (7, " "), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    first_z = min(z, near_z, key=lambda t: hashlib.sha256(t.encode()).digest())
    want = [(3, x), (5, y), (None, first_z), (None, prose(60, 34)), (6, None), (7, " "), (None, None)]
    for parts in (1, 5):
        got = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), "")
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


# -- 5 -----------------------------------------------------------------------


def test_url_rules_and_verdicts(spark):
    urls = [None, "no scheme", "http://A.Example.COM/de/x?y#z", "https://example.net/en/1", "https://www.example.net/fr/1#t", "http://net", "http://net/", "http://x.org/fr/", "http://x.org?q=/fr/", "ftp://u/%41/1234abcd99/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'x' as host", "1 as purity")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert [got[i]["host"] for i in range(len(urls))] == ["", "", "a.example.com", "example.net", "www.example.net", "net", "net", "x.org", "x.org", "u"]
    assert [got[i]["path"] for i in range(len(urls))] == ["", "", "/de/x", "/en/1", "/fr/1", "", "/", "/fr/", "", "/%41/1234abcd99/"]
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, "example.com/de/", "example.net/en/", "net/", None, "net/", "org/fr/", None, None]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_impure_templates_are_rejected(spark):
    rows = [(f"http://h.com/spam/{i}", 1 if i < 60 else None) for i in range(80)] + [(f"http://h.com/good/{i}", 0 if i < 60 else None) for i in range(80)]
    pages = spark.createDataFrame(rows, "url string, bad int")
    got = url_filter.judge_urls(pages, rules=(), label="bad").collect()
    assert {(r["template"], r["verdict"]) for r in got} == {("/spam/<n>", "block"), ("/good/<n>", "allow")}


def test_templates_reach_the_whole_path(spark):
    rows = []
    for i in range(80):
        day = f"http://h.com/2024/05/{i % 28}"
        rows += [(f"{day}/spam/a/{i}", 1 if i < 60 else None), (f"{day}/good/a/{i}", 0 if i < 60 else None)]
    # Pages that end where others go on, and one page far deeper on another host.
    rows += [("http://k.com/a/b/c/d", 1)] * 30 + [("http://k.com/a/b/c/d/e", 0)] * 30 + [("http://m.com/" + "/".join("qrstuvwxyz"), 1)] * 9
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, bad int"), rules=(), label="bad").collect()
    assert len(got) == len(rows)
    assert {(r["host"], r["template"], r["verdict"]) for r in got} == {
        ("h.com", "/<n>/<n>/<n>/spam/a/<n>", "block"), ("h.com", "/<n>/<n>/<n>/good/a/<n>", "allow"),
        ("k.com", "/a/b/c/d", "block"), ("k.com", "/a/b/c/d/e", "allow"),
        ("m.com", "/q/r/s/t/u/v/w/x/y/z", "block"),
    }
    # Depth on one host changes nothing on another.
    alone = url_filter.judge_urls(spark.createDataFrame(rows[160:220], "url string, bad int"), rules=(), label="bad")
    assert {r["verdict"] for r in alone.collect()} == {"allow", "block"}


# -- 6, 7 --------------------------------------------------------------------


@needs_tables
def test_quality_held_out():
    import pyarrow.parquet as pq

    sf = SF_DIR.replace("sf0.001", "sf0.01")
    both = pq.read_table(f"{sf}/documents.parquet").to_pandas().merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(x).encode()) % 3 == 1 for x in both.doc_id])
    raw = [np.frombuffer(quality_cnn.spread_chunks(t.encode()), np.uint8) for t in both.text[~held]]
    model = quality_cnn.train(raw, both.quality[~held].to_numpy(), epochs=6)
    scores = quality_cnn.score_texts(model, [np.frombuffer(t.encode(), np.uint8) for t in both.text[held]])
    assert ((scores >= 0.5) == both.quality[held]).mean() > 0.93
    # A text is scored alike alone and among others.
    one = quality_cnn.score_texts(model, [np.frombuffer(both.text[held].iloc[0].encode(), np.uint8)])
    assert abs(one[0] - scores[0]) < 1e-5


def test_quality_scores_equal_plain_loops():
    rng = np.random.default_rng(3)
    model = quality_cnn.train([rng.integers(32, 120, n).astype(np.uint8) for n in (40, 900, 3000, 0)], np.array([0, 1, 0, 1]), epochs=1)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 5, 383, 384, 512, 513, 896, 897, 2500)]
    for text, got in zip(texts, quality_cnn.score_texts(model, texts)):
        body = np.concatenate((text if len(text) else np.zeros(1, np.uint8), np.zeros(quality_cnn.WIDTH - 1, np.uint8)))
        n = max(1, len(text))
        r = np.array([sum(model.tables[k][body[i + k]] for k in range(quality_cnn.WIDTH)) for i in range(n)])
        chunks, at = [], 0
        while True:
            chunks.append(np.maximum(r[at : at + quality_cnn.CHUNK].max(0) + model.bias, 0))
            if at + quality_cnn.CHUNK >= n:
                break
            at += quality_cnn.STRIDE
        assert got == pytest.approx(1 / (1 + np.exp(-(np.mean(chunks, 0) @ model.weights + model.intercept))), abs=1e-5)


def test_training_draws_from_the_whole_text():
    text = np.arange(60_000) // quality_cnn.CHUNK
    kept = np.frombuffer(quality_cnn.spread_chunks(text.astype(np.uint8).tobytes()), np.uint8)
    assert len(kept) <= quality_cnn.DRAWN * quality_cnn.CHUNK and kept[0] == 0 and kept[-1] == text[-1]
    rng = np.random.default_rng(1)
    drawn = {int(x) for _ in range(40) for x in quality_cnn._drawn(kept, rng)[:: quality_cnn.CHUNK]}
    assert len(drawn) > 40


def test_quality_without_labels_and_edges(spark):
    docs = docs_of(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_cnn.fit(docs, none, none.doc_id >= 0) is None
    assert {r["score"] for r in quality_cnn.score(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 0), (7, 1), (7, 1), (8, None)], "doc_id long, quality int")
    scored = quality_cnn.score(docs, quality_cnn.fit(docs, labels, labels.doc_id >= 0)).collect()
    assert len(scored) == len(EDGES) and all(0 <= r["score"] <= 1 for r in scored)


def test_dictionaries_take_shares_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_BYTES", 300 * 512)
    rows = [(i, f"lang{i % 300:03d}", f"w{i}a " * 400 + f"w{i}z " * 400) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    made = dict(language_id.fit(docs, docs.doc_id >= 0))
    assert len(made) == 300 and max(map(len, made.values())) <= 512
    # All three rows of a language are in its dictionary, with their beginnings and ends.
    assert all(f"w{i}{end}".encode() in made["lang007"] for i in (7, 307, 607) for end in "az")
    sizes = language_id.Compressors([("a", b"x" * 300), ("b", b"y" * 300)])
    import zstandard

    for text in (b"xyz" * 400, b"q"):
        want = []
        for content in (b"x" * 300, b"y" * 300):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            want.append(sum(len(c.compress(text[i : i + 512])) for i in range(0, len(text), 512)))
        assert sizes.sizes(text) == want


def test_language(spark):
    r = random.Random(2)
    say = lambda words: " ".join(r.choice(words.split()) for _ in range(60))
    words = {"en": "the house is of wood and was built by them with that", "fr": "la maison est en bois et elle a été faite par eux avec des"}
    rows = [(i, say(words[k]), k) for i in range(40) for k in [("en", "fr")[i % 2]]] + [(90, None, "en"), (91, "123 !", None), (92, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.identify(docs, language_id.fit(docs, docs.doc_id < 20)).collect()}
    assert all(got[i]["best"] == ("en", "fr")[i % 2] for i in range(40))
    assert {got[i]["best"] for i in (90, 91, 92)} == {"und"} and got[91]["score"] == 0
    assert {x["lang"] for x in language_id.identify(docs, []).collect()} == {"und"}
    assert language_id.decide(["a", "b"], [100, 100])[0] == "a" and language_id.decide(["a", "b"], [101, 100])[2] < 0.02


# -- 8 -----------------------------------------------------------------------


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(line_dedup.BLANK)]
        gone = set()
        # A text of one or two lines is one window of all its lines.
        for k in range(max(len(filled) - 2, min(1, len(filled)))):
            window = tuple(lines[i].strip(line_dedup.BLANK) for i in filled[k : k + 3])
            if window in seen:
                for j in range(k, min(k + 3, len(filled))):
                    gone |= set(range(filled[j], filled[j + 1] if j + 1 < len(filled) else len(lines)))
            seen.add(window)
        out.append((None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(5)
    texts = [*EDGES, "a\nb\nc\nd", "x\na\n\n b\t\nc\n\ny", "a\na\na\na\na", "a\nb", "\n\n\n\n"]
    texts += ["\n".join(r.choice(["p", "q", "", " p", "r"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    docs = docs_of(spark, texts).withColumnRenamed("source", "n_lines")
    got = [(x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()]
    assert got == brute_lines(texts)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_short_documents_form_one_window(spark):
    texts = ["p q", " p q\t\n\n", "a\nb", "x\n\ny", "a\n \nb\n", "b", "b\na", "a\nb\nc", "p q\nz", None, "", "\n", "a\nb\nc"]
    got = [(x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    none = line_dedup.dedup_lines(docs_of(spark, texts[:8]), short=False)
    assert none.filter("n_removed > 0").count() == 0
    want = [(t, len((t or "").split("\n")), 0) for t in texts]
    want[1], want[4], want[12] = ("", 3, 3), ("", 4, 4), ("", 3, 3)
    assert got == want


# -- 9 -----------------------------------------------------------------------


def test_word_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    r = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "é", "9", "½", "!", "　", "A", "日", "\t", "<|endoftext|>"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(4000)] + [t or "" for t in EDGES]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for cache in (50, 100_000):
        encoder, got = packing.WordEncoder(queries.tokenizer_path(), cache), []
        for b in B.blocks(pa.array([t.encode() for t in texts]), 5_000):
            ids, at = encoder.encode(b)
            got += [ids[at[i] : at[i + 1]].tolist() for i in range(b.hi - b.lo)]
        assert got == want


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*EDGES, *(prose(n * 7 % 400, n) for n in range(200))]
    pieces = packing.pack(docs_of(spark, texts).repartition(3, "doc_id"), queries.tokenizer_path(), open_windows=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in enumerate(texts):
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            cut = np.array(ids[at : at + p["length"]], "<u4")
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(cut.tobytes()) and p["doc_tokens"] == len(ids)
            at += p["length"]
        assert at == len(ids)
    used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.SIZE and {p["sequence_length"] for p in own} == {at}
        used += at
    assert used / (len(by_sequence) * packing.SIZE) > 0.9
    assert packing.pack(docs_of(spark, texts).limit(0), queries.tokenizer_path()).count() == 0


def test_added_tokens_equal_the_plain_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    end, r = "<|endoftext|>", random.Random(2)
    parts = [end, end, "<|", "endoftext", "|>", " ", "  ", "\n", "'", "s", "é", "9", "日", "A"]
    texts = [f"a {end} b", end, end * 3, f" {end}", f"{end}\n", "plain", "", "x" * 3000 + f" {end} 's"]
    texts += ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(3000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    encoder, got = packing.TextEncoder(queries.tokenizer_path()), []
    for b in B.blocks(pa.array([t.encode() for t in texts]), 5_000):
        ids, at = encoder.encode(b)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(b.hi - b.lo)]
    assert got == want
    some = texts[:40]
    for p in packing.pack(docs_of(spark, some), queries.tokenizer_path()).collect():
        ids = [*want[p["doc_id"]], 0]
        cut = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(cut.tobytes())


# -- 10 ----------------------------------------------------------------------


def test_license_scan(spark):
    texts = [*EDGES, "MIT License", "the mit-license, General Public\nLicense mit license", "xmit license", "Licensed under the Apache Licence, Version 2.0.", "é mit license é APACHE license"]
    got = license_scan.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
        at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in license_scan.PHRASES}
        every = sorted(i for x in at.values() for i in x)
        assert (r["n_words"], r["n_base"]) == (len(words), len(every))
        assert (r["first_word"], r["last_word"]) == ((every[0], every[-1]) if every else (None, None))
        assert r["base_labels"] == ",".join(sorted(license_scan.PHRASES[p] for p, x in at.items() if x))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[len(EDGES) + 3]["labels"] == "apache" and got[len(EDGES) + 3]["spans"][0]["edits"] == 1


def test_seeds_find_every_notice_within_its_edits():
    finder, r = license_scan.NoticeFinder(), random.Random(6)
    for _ in range(150):
        k = r.randrange(len(finder.notices))
        n = finder.notices[k]
        text = list(n.text)
        for _ in range(r.randint(0, n.edits)):
            text[r.randrange(1, len(text) - 1)] = r.choice("abcz")
        whole = f"{prose(20, 1)} {''.join(text)} {prose(20, 2)}"
        assert k in {h[0] for h in finder.verify(whole, finder.seeds_in(whole))}


def _edits_within(text, notice, most):
    """Least edits of a run of whole words of a text against a notice, if at most ``most``."""
    words, best = text.split(), None
    size = len(notice.split())
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + size + most + 1) + 1):
            part = " ".join(words[i:j])
            if abs(len(part) - len(notice)) > most:
                continue
            row = list(range(len(part) + 1))
            for a, x in enumerate(notice, 1):
                last, row[0] = row[0], a
                for b, y in enumerate(part, 1):
                    last, row[b] = row[b], min(row[b] + 1, row[b - 1] + 1, last + (x != y))
            if row[-1] <= most:
                best = row[-1] if best is None else min(best, row[-1])
    return best


def test_labels_equal_edit_distance_on_whole_words():
    finder, r = license_scan.NoticeFinder(), random.Random(16)
    tails = ["ple terms", "lad bowl", "xyzabc", "", " and more", "s", "x"]
    for _ in range(120):
        n = r.choice(finder.notices)
        text = list(n.text)
        for _ in range(r.randint(0, n.edits + 1)):
            at = r.randrange(len(text))
            text[at : at + r.randint(0, 1)] = r.choice(["", "x", "q", " "])
        whole = " ".join(f"{prose(r.randint(0, 5), r.random())} {r.choice(['', 'un'])}{''.join(text)}{r.choice(tails)} {prose(r.randint(0, 5), r.random())}".split())
        found = {finder.notices[k].text: edits for k, _, _, edits in finder.verify(whole, finder.seeds_in(whole))}
        for other in finder.notices:
            assert found.get(other.text) == _edits_within(whole, other.text, other.edits), (whole, other.text)


def test_no_label_ends_inside_a_word():
    finder = license_scan.NoticeFinder()
    for text in ("licensed under cc by sample terms", "this is licensed under cc by salad bowl", "all rights reserved no part of thistle", "licensed under cc by ncxyzabc"):
        assert finder.verify(text, finder.seeds_in(text)) == []


def test_many_notices_take_time_in_proportion():
    finder, seconds = license_scan.NoticeFinder(), []
    for n in (1000, 10_000):
        text = " ".join(["licenced under cc by nc"] * n)
        start = time.perf_counter()
        hits = finder.verify(text, finder.seeds_in(text))
        seconds.append(time.perf_counter() - start)
        assert sum(finder.notices[h[0]].label == "cc-by-nc" for h in hits) == n
    assert seconds[1] < 30 * max(seconds[0], 0.05)


def test_license_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", "x", "y"), (1, None, "x", "y")], "doc_id long, text string, labels string, found string")
    got = license_scan.scan(docs)
    assert got.columns[:3] == ["doc_id", "text", "found"] and got.columns.count("labels") == 1
    assert [r["labels"] for r in got.collect()] == ["mit", ""] and license_scan.scan(docs.limit(0)).count() == 0


def test_adjacent_notices_are_both_reported():
    finder = license_scan.NoticeFinder()
    for text, edits in (("licenced under cc by nc licensed under cc by nc", [1, 0]), ("licensed under cc by nc licenced under cc by nc", [0, 1])):
        hits = [h for h in finder.verify(text, finder.seeds_in(text)) if finder.notices[h[0]].label == "cc-by-nc"]
        assert [h[3] for h in hits] == edits and hits[0][2] <= 24 <= hits[1][1] + 1


# -- pipeline ----------------------------------------------------------------


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.schema.names == docs.schema.names
        rows = kept.collect()
        if name == "line_dedup":
            before = docs.orderBy("doc_id").collect()
            want = [(r["doc_id"], t) for r, (t, _, gone) in zip(before, brute_lines([r["text"] for r in before])) if not gone or t.strip()]
            assert sorted((r["doc_id"], r["text"]) for r in rows) == want
        if name == "near_duplicates":
            before = docs.orderBy("doc_id").collect()
            want = [before[i]["doc_id"] for i, _, root in brute_components([r["text"] for r in before]) if i == root]
            assert sorted(r["doc_id"] for r in rows) == want
        assert len({r["doc_id"] for r in rows}) == len(rows) <= n and len(rows) > 0.6 * n
        docs = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.pack(spark, docs, SF_DIR)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in rows}


def test_tasks_travel_without_tables_of_the_driver():
    from pyspark import cloudpickle

    for block in B.blocks(pa.array([b"one two three four five six"], pa.binary())):
        assert len(B.words(block, B.SPACED).hash) == 6
    raw = cloudpickle.dumps(ngram_join._sketcher(5, 4))
    assert len(raw) < 200_000
    cloudpickle.loads(raw)


# -- columns of other names ----------------------------------------------------


CLASHES = "_lower _text score _own _id _tid _at _dk _gone _keep _lines _filled _key _shape _host _tshape _row row n_lines n_removed found cut ids".split()


def test_clashing_columns_pass_through(spark):
    texts = [*EDGES, prose(60, 1), prose(60, 1), prose(60, 2) + "\na\nb\nc\n", "x\na\nb\nc"]
    docs = docs_of(spark, texts)
    for c in CLASHES:
        docs = docs.withColumn(c, queries.F.concat(queries.F.lit(c), queries.F.col("doc_id").cast("string")))

    def same(df, names=CLASHES):
        rows = df.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
        return len(rows)

    items = spark.createDataFrame([(1, prose(60, 2))], "item_id long, text string")
    assert same(decontaminate.decontaminate(docs, items)) == len(texts) - 1
    assert same(quality_cnn.accepted(docs, None)) == len(texts)
    assert same(line_dedup.without_repeats(docs)) == len(texts) - 1  # of equal one-line documents all but one lose their text
    assert same(line_dedup.dedup_lines(docs), [c for c in CLASHES if not c.startswith("n_")]) == len(texts)
    assert same(ngram_join.keep_representatives(docs)) == len(texts) - 1
    assert same(license_scan.scan(docs), [c for c in CLASHES if c != "score"]) == len(texts)
    pages = docs.withColumn("url", queries.F.lit("http://h.com/a/1"))
    assert same(url_filter.judge_urls(pages)) == len(texts)
    for stage in (quality_cnn.accepted(docs.limit(0), None), line_dedup.without_repeats(docs.limit(0)), ngram_join.keep_representatives(docs.limit(0)), decontaminate.decontaminate(docs.limit(0), items)):
        assert stage.columns == docs.columns and stage.count() == 0
