"""The pipeline, stage by stage, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from sievework.llm import mixing, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = draw(70)
    rows = []
    for i in range(50):
        words = draw(rng.randint(11, 90))
        if i % 5 == 1:
            words = draw(30) + passage + draw(30)
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    rows += [(60, rows[0][1], "en", "s0"), (61, rows[2][1] + " z", "en", "s1"), (62, "too short", "en", "s1"), (63, "a b c d e " * 20, "en", "s2"), (64, None, None, None), (65, " ".join(passage), "en", "s2")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def shingles(text):
    w = re.findall(WORD, text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got.append(docs.collect())
        assert k == 4 or docs.columns == columns

    # Without labels only the base rule rejects.
    def good(text):
        words = re.findall(WORD, text or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + o for k in range(len(words) - 4) for o in range(5) if windows[tuple(words[k : k + 5])] > 1}
        return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)

    kept = [r for r in rows if good(r[1])]
    assert sorted(r["doc_id"] for r in got[0]) == [r[0] for r in kept] and {62, 63, 64}.isdisjoint(r[0] for r in kept)

    left = []
    sets = {r[0]: shingles(r[1]) for r in kept}
    for r in kept:  # in order of doc_id; the groups here are stars around their first document
        if not any(100 * len(sets[r[0]] & sets[o[0]]) >= 75 * len(sets[r[0]] | sets[o[0]]) for o in left):
            left.append(r)
    assert sorted(r["doc_id"] for r in got[1]) == [r[0] for r in left] and {60, 61}.isdisjoint(r[0] for r in left)

    seen, cut = set(), {}
    size = suffix_dedup.PASSAGE
    for r in left:
        raw = r[1].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = True
            seen.add(raw[k : k + size])
        text = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
        if re.search(WORD, text):
            cut[r[0]] = text
    assert {r["doc_id"]: r["text"] for r in got[2]} == cut and all(r["n_chars"] == len(r["text"]) for r in got[2])
    assert 65 not in cut and any(cut[r[0]] != r[1] for r in left if r[0] in cut)

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert Counter(r["doc_id"] for r in got[3]) == Counter({i: c for i, c in copies.items() if c})

    ranks = corpus_pipeline.bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(got[4]) == len(got[3])
    for r in got[4]:
        ids = own.encode_ordinary(cut[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(cut[r["doc_id"]].encode()).hexdigest()


def test_repeats_of_fifty_one_short_words_are_cut(spark):
    passage = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}q" + "z" * (k % 2) for k in range(51))
    assert len(passage.split()) == 51 and 225 <= len(passage) < 240
    docs = [(i, f"{head} {passage} {tail}", "en", "s", 0) for i, head, tail in ((1, "first of them", "here it ends"), (2, "another one", "and so on"))]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert got[1] == docs[0][1] and passage not in got[2] and len(got[2]) < 40


def test_run_agrees_with_the_stages(spark, tmp_path):
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    """Each stage takes no rows, and columns with names that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, tid long, rep long, rate double, class long, bucket string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = "Every word of this short text is there once and none is there again."
    for name, rows in (("none", []), ("one", [(1, clean, "en", "s", len(clean), 1, "k", 2, 3, 0.5, 4, "b")])):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == [c.split()[0] for c in schema.split(", ")]
            assert k == 3 or docs.count() == len(rows) or k == 4
