"""Pairs of lines that the line join verifies."""

import random

from sparkloom.llm import line_dedup


def test_unlike_pairs_are_ruled_out_before_tokens_are_sent(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(14)]
    lines = [[word() for _ in range(3)] + passage + [word() for _ in range(3)] for _ in range(60)]
    lines += [[*w[:-1], word()] for w in lines[:5]]  # 15 of 17 tokens in common, and 10 with all others
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string")
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in lines]
    want = [k for k, a in enumerate(runs) if not any(5 * len(a & b) >= 4 * len(a | b) for b in runs[:k])]
    sent, similar = [], line_dedup._similar

    def spied(pairs, sets):
        sent.append(pairs.count())
        return similar(pairs, sets)

    monkeypatch.setattr(line_dedup, "BUCKET_BITS", 1)  # as in large tables, where the passage does not stand out of its buckets
    monkeypatch.setattr(line_dedup, "HALF", 1)
    monkeypatch.setattr(line_dedup, "_similar", spied)
    kept = line_dedup.kept_lines(docs).collect()
    assert sorted(r["id"] for r in kept) == want == list(range(60))
    assert 5 <= sum(sent) < 60
