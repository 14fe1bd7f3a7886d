"""The pipeline's stages, each on its own input, at the smallest scale."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as P  # noqa: E402

from trackloom.llm.common import stored, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text: str | None, n: int = 5) -> set:
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").split()]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_groups(rows) -> dict:
    """doc_id -> the smallest id that links reach."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    least = {d: d for d in sets}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_stages_on_their_own_inputs(spark):
    docs = table(spark, SF, "documents")
    columns, toxic = docs.columns, {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    labelled = {r.doc_id for r in table(spark, SF, "labels").collect()}
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF))
        after = docs.collect()
        gone = {r.doc_id for r in before} - {r.doc_id for r in after}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            assert not (gone & labelled) - toxic
        elif name == "minhash_near_dedup":
            assert gone == {d for d, low in brute_groups(before).items() if d != low}
        elif name == "benchmark_decontamination":
            items = [r.text for r in table(spark, SF, "benchmark").collect() if r.text]
            assert {r.doc_id for r in before if any(t in (r.text or "") for t in items)} <= gone
        else:
            assert not gone and len(after) == len(before)
    assert all(r.round_trip for r in after)
