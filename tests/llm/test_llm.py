"""The corpus operators against brute force, with nulls, empty and long texts, repeats and empty tables."""

import re
import textwrap
import time
import weakref
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.exact import near_components
from trackloom.llm import chat_format, decontamination, license_scans, near_dups, pieces, quality_rules, secret_scans, sharding, toxicity, url_filters

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{k}" for k in range(400)]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOC)


def sample(n=60, seed=3):
    r = np.random.RandomState(seed)
    base = [" ".join(r.choice(WORDS, 80)) for _ in range(6)]
    out = []
    for k in range(n):
        w = base[k % 6].split()
        for at in r.randint(0, len(w), r.randint(0, 5)):
            w[at] = r.choice(WORDS)
        out.append(" ".join(w))
    return [*out, None, "", "  \n", "one two", "ONE Two", out[0], "x " * 3000]


def test_url_filters(spark):
    urls = ["http://www.example.com/en/1?q#f", "https://a.EXAMPLE.com/en/", "http://b.net/es/x", "http://b.net/de/x", None, "", "no scheme", "http://spam-farm.example.org/x", "http://example.com", "http://x.org?u=http://example.com/en/", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("old"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2][2:] == ("net/es/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "block")
    assert got[7][2:] == (None, "block") and got[8] == ("example.com", "", None, "allow")
    assert got[9][:3] == ("x.org", "", None) and got[10][2] == "com/"
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    texts = sample()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs(spark, texts)).collect()}
    assert got == near_components(list(enumerate(texts)))
    assert near_dups.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    r = np.random.RandomState(5)
    base = list(r.choice(WORDS, 120))
    texts = []
    for _ in range(150):
        w = list(base)
        for at in r.randint(0, 120, r.randint(0, 12)):
            w[at] = r.choice(WORDS)
        texts.append(" ".join(w))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dups.near_duplicates(docs(spark, texts)).collect()}
    assert got == near_components(list(enumerate(texts)))


@pytest.mark.parametrize("few", [near_dups.FEW, 0])
def test_components_of_a_small_graph_need_no_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(near_dups, "FEW", few)
    name = lambda k: f"{k:04d}".encode()
    edges = [(name(k), name(k + 1)) for k in range(0, 59)] + [(name(100), name(k)) for k in range(101, 140)] + [(name(201), name(200)), (name(201), name(200))]
    given = spark.createDataFrame(edges, "a binary, b binary")
    sc, scratch = spark.sparkContext, []
    sc.setJobGroup(f"components {few}", "")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = near_dups.components(given, scratch).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {name(k): name(0) for k in range(60)} | {name(k): name(100) for k in range(100, 140)} | {name(k): name(200) for k in (200, 201)}
    assert len(rows) == len(want) and {bytes(r.node): bytes(r.comp) for r in rows} == want
    stages = [sc.statusTracker().getStageInfo(x) for j in sc.statusTracker().getJobIdsForGroup(f"components {few}") for x in sc.statusTracker().getJobInfo(j).stageIds]
    shuffled = sum(x.numTasks == 7 for x in stages if x and x.numCompletedTasks)
    sc.setLocalProperty("spark.jobGroup.id", None)
    near_dups.forget(spark, scratch)
    assert shuffled == 0 if few else shuffled > 3


SECRETS = ['a password = "hunter2hunter2" b', "token=token:abcdefg", "AKIA" + "A" * 16, "é AKIAAKIA" + "B" * 12 + "!", "0" * 24 + " " + "f" * 23, "api_key: 12345", "APIKEY='abcdef' secret=xx", None, "", "x" * 50000 + "ghp_" + "a" * 36]


def brute_secrets(text):
    out = []
    for k, m in ((0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), (1, r"AKIA[A-Z0-9]+"), (2, r"[0-9a-f]+")):
        for x in re.finditer(m, text or ""):
            size = len(x.group(2)) if k == 0 else x.end() - x.start()
            if size >= (6, 20, 24)[k]:
                out.append((x.start(), k, x.end()))
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secret_scans(spark):
    found = secret_scans.scan_secrets(docs(spark, SECRETS))
    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    got = {r.doc_id: r.b for r in found.select("doc_id", secret_scans.joined(base).alias("b")).collect()}
    assert got == {k: brute_secrets(t) for k, t in enumerate(SECRETS)}
    text = {r.doc_id: r.text for r in secret_scans.redact(found).collect()}
    assert text[0] == 'a <assign>" b' and text[9].endswith("x<github>") and text[7] is None
    assert secret_scans.trigram_query(r"[0-9a-f]{24,}") == []
    assert secret_scans.scan_secrets(docs(spark, SECRETS).limit(0)).count() == 0


def test_sharding(spark):
    texts = [f"text {k} " + "x" * (k % 50) for k in range(500)] + [None, "", "same", "same"]
    rows = sharding.assign(docs(spark, texts), shards=4, slots=64)[0].collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for k in range(4):
        own = sorted(r.slot for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))
    load = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
    assert max(load) < 1.05 * min(load)


def test_slot_map_moves_only_into_new_shards(spark, tmp_path):
    m = sharding.SlotMap.build({s: (100 + s, 1) for s in range(64)}, 4, 64)
    n = m.rebalanced(shards=5)
    assert n.version == 2 and {n.shard_of[s] for s in n.shard_of if n.shard_of[s] != m.shard_of[s]} == {4}
    assert max(n.bytes_of()) < 1.1 * min(n.bytes_of())
    m.save(spark, str(tmp_path / "map"))
    n.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).shard_of == n.shard_of
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == m.shard_of


def test_license_scans(spark):
    mit = license_scans.KNOWN["MIT"]
    texts = ["Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper(), "prose\nLicensed under CC BY-NC 4.0.\nmore", mit + " but", None, ""]
    got = {r.doc_id: (r.license, r.notices) for r in license_scans.scan_licenses(docs(spark, texts).withColumn("license", F.lit("x"))).collect()}
    assert got == {0: ("MIT", []), 1: (None, ["CC-BY-NC-4.0"]), 2: (None, []), 3: (None, []), 4: (None, [])}


def test_license_files_with_headings_and_wrapped(spark):
    known = license_scans.KNOWN
    wrapped = lambda name, width: "\n\n".join(textwrap.fill(p, width) for p in known[name].split("\n\n"))
    head = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "0BSD": "Zero-Clause BSD"}
    want = [(n, f"{h}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{wrapped(n, w)}\n") for n, h in head.items() for w in (30, 43, 60, 72, 79)]
    want += [(n, f"Copyright 2020 Someone\n{wrapped(n, 70)}") for n in head]
    want += [("BSD-3-Clause", f"© Someone\n{wrapped('BSD-3-Clause', 80).replace('1. ', '* ').replace('2. ', '* ').replace('3. ', '* ')}")]
    for n in license_scans.LONG:
        text = (Path(license_scans.__file__).parent / "licenses" / f"{n}.txt").read_text()
        want += [(n, text), (n, text.replace("\n", "\r\n"))]
    want += [("MIT", "SOFTWARE.".join(wrapped("MIT", 70).rsplit("SOFTWARE.", 1)).replace("NO EVENT SHALL THE AUTHORS OR", "NO EVENT SHALL THE AUTHORS OR\n"))]
    want += [(None, f"Copyright holders, read this\n{known['MIT']}"), (None, "MIT License")]
    got = {r.doc_id: r.license for r in license_scans.scan_licenses(docs(spark, [t for _, t in want])).collect()}
    assert [(k, got[k]) for k in range(len(want)) if got[k] != want[k][0]] == []
    assert all(re.search(license_scans.LINE_HINT, t) for _, t in license_scans.known_texts())
    own = license_scans.known_licenses(spark, [("Own", "Free for all.")])
    assert [r.notices for r in license_scans.scan_licenses(docs(spark, ["a\nFree for all.\nb"]), own).collect()] == [["Own"]]


@pytest.mark.parametrize("text", ["", "hello world", "  two   spaces ", "naïve 漢字 \U0001f600 \x00", "a" * 5000, "x\ny\tz"])
def test_pieces_round_trip_and_library(text):
    import sentencepiece

    path = "/opt/tokenizers/piece_bpe_32k.model"
    own = pieces.Encoder(pieces.load(path))
    ids = own.encode(text)
    assert own.decode(ids) == text
    assert ids == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_unigram_viterbi_is_best():
    r = np.random.RandomState(2)
    v = pieces.Vocabulary([("<unk>", 0.0, pieces.UNKNOWN)] + [("".join(p), float(-r.rand() * 5), pieces.NORMAL) for n in (1, 2, 3) for p in {tuple(r.choice(list("abc▁"), n)) for _ in range(12)}], pieces.UNIGRAM, dummy_prefix=False, squeeze=False)
    own = pieces.Encoder(v)
    for _ in range(60):
        text = "".join(r.choice(list("abc▁"), 9))
        best = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - 3), e):
                if text[s:e] in own.id:
                    best[e] = max(best[e], best[s] + own.score[own.id[text[s:e]]])
            best[e] = max(best[e], best[e - 1] + own.lowest)
        assert abs(sum(own.score[k] if k else own.lowest for k in own._segments(text)[1]) - best[-1]) < 1e-6


def test_encoders_without_tasks_go(monkeypatch):
    """Worker processes outlive their tasks: the next task gets the same encoder, and after a while without tasks it goes with what it remembers."""
    monkeypatch.setattr(pieces, "IDLE", 0.3)
    shared = SimpleNamespace(value=pieces.Vocabulary([("<unk>", 0.0, pieces.UNKNOWN), ("▁a", -1.0, pieces.NORMAL), ("b", -2.0, pieces.NORMAL)]))
    with pieces._encoder(shared) as own:
        assert own.encode("ab a") == [1, 2, 1]
        gone = weakref.ref(own)
    with pieces._encoder(shared) as own:
        assert own is gone()
        time.sleep(0.6)  # a task of any length keeps it
        assert pieces._ENCODERS
    del own
    deadline = time.monotonic() + 10
    while gone() is not None and time.monotonic() < deadline:
        time.sleep(0.05)
    assert gone() is None


def test_texts_of_a_column_in_slices(monkeypatch):
    monkeypatch.setattr(near_dups, "SLICE", 3)
    values = [b"a", None, b"", *[b"x" * k for k in range(6)]]
    for n in range(len(values) + 1):
        assert list(near_dups._texts(pa.array(values[:n], pa.binary()))) == values[:n]


def test_decontamination(spark):
    r = np.random.RandomState(4)
    items = [" ".join(r.choice(WORDS, n)) for n in (20, 35, 60, 6)]
    noise = lambda n: " ".join(r.choice(WORDS, n))
    edited = []
    for item in items[:3]:
        w = item.split()
        for at in r.choice(len(w) - 2, int(0.15 * len(w)), replace=False) + 1:
            w[at] = "zzz"
        edited.append(" ".join(w))
    texts = [f"{noise(50)} {t} {noise(50)}" for t in (*items, *edited)] + [noise(300), None, "", items[0].upper().replace(" ", ", "), "the " * 3000]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {x.doc_id: [h.item_id for h in x.leaks] for x in decontamination.leaks(docs(spark, texts), bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [3], 4: [0], 5: [1], 6: [2], 7: [], 8: [], 9: [], 10: [0], 11: []}
    assert all(not x.leaks for x in decontamination.leaks(docs(spark, texts), bench.limit(0)).collect())


def test_decontamination_of_dropped_clauses():
    """Recall at the full rate of edits, in blocks: one or two clauses dropped, one added or replaced, wherever it is."""
    r = np.random.RandomState(11)
    vocabulary = [f"v{k}" for k in range(5000)]
    s = decontamination.Settings()
    noise = lambda n: list(r.choice(vocabulary, n))
    for m in (10, 15, 20, 31, 40, 60, 100):
        n = s.edits(m)
        items = [noise(m) for _ in range(12)]
        index = decontamination.Index([(k, " ".join(w)) for k, w in enumerate(items)], s)
        for k, w in enumerate(items):
            trials = [w[:at] + w[at + n :] for at in (1, 2, 5, m // 2 - n // 2, m - n - 1)]
            trials += [w[: m // 4] + w[m // 4 + n // 2 : m * 5 // 8] + w[m * 5 // 8 + n - n // 2 :], w[:2] + noise(n) + w[2:], w[:2] + ["zz"] * n + w[2 + n :]]
            for x in trials:
                hits = [h for h in index.search(" ".join(noise(60) + x + noise(60))) if h[0] == k]
                assert len(hits) == 1 and 60 - n <= hits[0][1] <= 62 + n and hits[0][3] <= n
            # The document begins or ends within the item.
            assert [h[0] for h in index.search(" ".join(w[n:] + noise(60)))] == [k] == [h[0] for h in index.search(" ".join(noise(60) + w[:-n]))]


def test_decontamination_verifies_only_windows_with_the_item_s_sequences(monkeypatch):
    """Items of the same words, three at a time in another order, meet in their samples; their windows need no edit distance."""
    r = np.random.RandomState(13)
    verified = []
    plain = decontamination.edit_distances
    monkeypatch.setattr(decontamination, "edit_distances", lambda x, windows, most: verified.append(x.tolist()) or plain(x, windows, most))
    for _ in range(5):
        parts = [[f"v{r.randint(10**6)}" for _ in range(3)] for _ in range(11)]
        items = [" ".join(w for k in range(11) for w in parts[k * stride % 11]) for stride in range(1, 11)]
        index = decontamination.Index(list(enumerate(items)), decontamination.Settings())
        for k, item in enumerate(items):
            verified.clear()
            assert [h[0] for h in index.search(f"{WORDS[0]} {item} {WORDS[1]}")] == [k]
            assert verified == [index.items[k][1].tolist()]


def test_decontamination_over_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    r = np.random.RandomState(12)
    items = [" ".join(r.choice(WORDS, 20)) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert [len(b) for b in decontamination.blocks(bench, "item_id", "text")] == [2, 2, 1]
    got = {x.doc_id: [h.item_id for h in x.leaks] for x in decontamination.leaks(docs(spark, items), bench).collect()}
    assert got == {k: [k] for k in range(5)}


def test_chat_format(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "<|im_end|>"), (2, "chosen", 0, None, None), (None, "chosen", 0, "user", "x")]
    got = {r.pair_id: r for r in chat_format.format_pairs(spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")).collect()}
    r = got[1]
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.n_prompt_turns == 1
    assert r.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and r.rejected == "<|im_start|>assistant\n<| im_end|><|im_end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["good<|im_end|>"]
    assert got[2].n_prompt_turns == 0 and got[2].rejected == "" and set(got) == {1, 2}


def test_chat_branches_keep_conversations_without_an_answer(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "system", "be"), (2, 1, "user", "hm"), (3, 0, "assistant", "yes"), (4, 0, "user", None), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in chat_format.format_pairs(chat_format.branches(turns)).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[2]
    assert r.prompt == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>user\nhm<|im_end|>\n" and r.n_prompt_turns == 2
    assert (r.chosen, r.rejected, r.chosen_mask, r.rejected_mask, r.n_chosen_turns, r.n_rejected_turns) == ("", "", [], [], 0, 0)
    assert got[4].n_prompt_turns == 1 and got[1].n_prompt_turns == 1 and "good" in got[1].chosen and got[1].rejected == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert chat_format.format_pairs(chat_format.branches(turns.limit(0))).count() == 0


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    texts = ["a b c a b c d", "x\nx\n \nx", "", "é#* <|> z", "the of and " * 40, " ".join(WORDS[:120])]
    got = {r.doc_id: r for r in quality_rules.quality(docs(spark, [*texts, None])).collect()}
    for k, t in enumerate([*texts, ""]):
        assert tuple(got[k][c] for c in quality_rules.BASE) == brute_quality(t)
    assert got[4].base_failed and not got[5].base_failed and not got[6].kept
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0


def test_toxicity(spark):
    r = np.random.RandomState(6)
    labels, texts = [], []
    for k in range(900):
        bad = k % 5 == 0
        w = list(r.choice(WORDS, 60))
        if bad:
            for at in r.choice(60, 4, replace=False):
                w[at] = r.choice(["vile", "rotten", "nasty"])
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    d = docs(spark, [*texts, None, ""])
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {x.doc_id: x.toxicity.score for x in toxicity.score(d, model).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (k % 5 == 0) for k in held]) > 0.97
    assert got[900] == got[901] < 0.5
    empty = toxicity.fit(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert all(x.toxicity.score < 0.7 for x in toxicity.score(d.limit(5), empty).collect())


def test_maximal_segments_against_brute_force():
    r = np.random.RandomState(1)
    for _ in range(100):
        x = np.where(r.rand(25) < 0.4, r.randint(1, 6, 25), -1.0)
        scored = [(k, float(v)) for k, v in enumerate(x) if v != -1.0]
        best = max((x[a:b].sum() for a in range(25) for b in range(a + 1, 26)), default=0)
        assert max((s for s, _, _ in toxicity.maximal(scored, -1.0)), default=-1.0) == best
