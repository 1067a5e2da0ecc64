"""Byte BPE, source mix, license scans and the pipeline."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerlens.llm import byte_bpe, licenses, source_mix


@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    ranks = byte_bpe.read_ranks(path)
    return byte_bpe.codec_of(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})


def ids(code):
    return list(struct.unpack(f"<{len(code) // 4}I", code))


def test_perfect_hash_is_minimal_and_perfect(codecs):
    own, _ = codecs
    assert sorted(own.hash.slots.tolist()) == list(range(len(own.vocabulary)))
    assert own.hash.ranks(own.vocabulary).tolist() == list(range(len(own.vocabulary)))


PARTS = st.sampled_from([" ", "  ", "\n", " \n", "\t", "a", "Bc", "é", "12", "²", "!", "'s", "'ll", "　", "\xa0", "漢字", "😀", "word", "\r\n", "\x1c", "don't", "<|endoftext|>"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PARTS, max_size=15).map("".join)))
def test_bpe_equals_the_library(codecs, text):
    own, library = codecs
    text = text.encode("utf-8", "ignore").decode()
    assert ids(own.encode(text)) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_bpe_of_long_texts_and_full_memos(codecs, monkeypatch):
    own, library = codecs
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    monkeypatch.setattr(byte_bpe, "MEMO_CHARS", 3)
    for text in ("a" * 4000, "ab" * 2000, " " * 2000, " ".join(f"w{i}" for i in range(3000))):
        assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_bpe_keeps_no_long_pieces(codecs):
    own, library = codecs
    rng = random.Random(9)
    for _ in range(20):
        text = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000))
        assert ids(own.encode(text)) == library.encode_ordinary(text)
    assert max(map(len, [*own.one, *own.run])) <= byte_bpe.MEMO_CHARS


def test_bpe_of_a_pattern_that_joins_blanks(codecs):
    own, _ = codecs
    other = byte_bpe.Codec(own.vocabulary, r"\w+ \w+|.", own.hash)
    assert not other.by_blanks and own.by_blanks
    assert other.decode(other.encode("ab cd ef gh")) == b"ab cd ef gh"


def test_bpe_rows(docs, rows, no_docs, codecs):
    want = Counter()
    for r in rows:
        code = codecs[1].encode_ordinary(r[1] or "")
        want[r[0], len(code), hashlib.sha256(struct.pack(f"<{len(code)}I", *code)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    path, pattern = byte_bpe.default_vocabulary()
    got = byte_bpe.encoded(docs, path, pattern).collect()
    assert Counter(tuple(r)[:4] for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert byte_bpe.encoded(no_docs, path, pattern, digests_only=True).count() == 0


def brute_targets(sizes):
    """Targets by source: shares by weight, capped, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= above


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("shard_docs", [source_mix.SHARD_DOCS, 4])
def test_mix(docs, rows, no_docs, monkeypatch, shard_docs):
    monkeypatch.setattr(source_mix, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(source_mix, "FAN", 2 if shard_docs == 4 else source_mix.FAN)  # a deep tree of shards
    monkeypatch.setattr(source_mix, "RANK_ROWS", 2)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += n_words(r[1])
    targets = brute_targets(sizes)
    of = lambda r: None if r.skey[0] == "1" else r.skey[1:]
    got = source_mix.mix(docs).collect()
    assert Counter((r.doc_id, of(r), r["size"]) for r in got) == Counter((r[0], r[3], n_words(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[of(r)] and abs(r.target - targets[of(r)]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[of(r)] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(8, 0.01 * t), s
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.mix(docs.repartition(3)).collect()))
    assert source_mix.mix(no_docs).count() == 0


def test_mix_of_rows_without_ids(spark, monkeypatch):
    """Rows that share a doc_id, or have none, are dealt over the shards by their texts."""
    monkeypatch.setattr(source_mix, "SHARD_DOCS", 10)
    rows = [(None if i % 2 else 5, "a", f"w{i} x y z") for i in range(200)] + [(1000, "b", "q " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = source_mix.mix(docs).collect()
    assert len(got) == 201 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for key in ("0a", "0b"):
        assert abs(sum(r.taken for r in got if r.skey == key) - next(r.target for r in got if r.skey == key)) <= 4
    assert Counter(map(tuple, got)) == Counter(map(tuple, source_mix.mix(docs.repartition(7)).collect()))


def test_mix_of_many_sources_and_of_none(spark):
    rng = random.Random(4)
    rows = [(i, f"s{i % 37:02d}", " ".join("w" * rng.randint(0, 30))) for i in range(900)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.skey] += r.taken
        target[r.skey] = r.target
    assert all(abs(taken[s] - t) <= 4 for s, t in target.items())
    empty = source_mix.mix(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0)] * 2


@pytest.mark.parametrize("few", [10_000, 1, 3])
def test_level(spark, few):
    rng = random.Random(few)
    for _ in range(3):
        sizes = {f"s{i:03d}": rng.choice((0, 1, 5, 7, 40, 40, 1000, rng.randint(1, 10**6))) for i in range(rng.randint(1, 60))}
        want = brute_targets(sizes)
        rows = [(n, k % 3 + 1) for k, (s, n) in enumerate(sorted(sizes.items()))]
        level = source_mix.water_level(spark.createDataFrame(rows, "source_size long, weight long"), few)
        for (s, n), (_, w) in zip(sorted(sizes.items()), rows):
            assert abs(min(3.0 * n, level * w) - want[s]) <= 1e-6 * max(1, want[s])


def highest_quotients(shares, rooms, blocks):
    """Seats one by one to the highest share / (2k + 1) that has room; ties to the first."""
    seats = [0] * len(shares)
    for _ in range(blocks):
        free = [i for i in range(len(shares)) if seats[i] < rooms[i]]
        best = max(free, key=lambda i: (shares[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_quotas_equal_seats_given_one_by_one(spark):
    rng = random.Random(8)
    for _ in range(3):
        sizes = [rng.randint(1, 400) for _ in range(25)]
        want = brute_targets({f"s{i:02d}": n for i, n in enumerate(sizes)})
        rows = [(f"s{i:02d}", n, float(want[f"s{i:02d}"])) for i, n in enumerate(sizes)]
        got = source_mix.apportion_sources(spark.createDataFrame(rows, "skey string, source_size long, target double"), 4)
        blocks = max(1, round(sum(sizes) / 4))
        expected = highest_quotients([r[2] for r in rows], [-(-3 * n // 4) for n in sizes], blocks)
        assert [r.blocks for r in got.orderBy("skey").collect()] == expected


def test_mixed_rows(docs, no_docs):
    got = source_mix.mixed_rows(docs)
    assert got.columns == docs.columns
    most = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    given_rows = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert all(n <= 3 * given_rows[k] for k, n in most.items())
    assert source_mix.mixed_rows(no_docs).count() == 0


def test_patience_alignment():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.align("a b c x d e f".split(), "a c b d f".split()) == [(0, 0), (2, 1), (4, 3), (6, 4)]


def test_licenses():
    scan = licenses.Scanner()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            found = scan.find(f"the intro of a text. {t} and the rest of this work, under the program.")
            assert found[0].name == name and found[0].coverage == 1.0, t
    mit = licenses.TEMPLATES["MIT"][2].split()
    changed = " ".join(w for i, w in enumerate(mit) if i % 10)
    assert scan.find(changed)[0].name == "MIT" and scan.find(changed)[0].coverage > 0.85
    assert not scan.find(" ".join(mit[:30]))
    for foreign in (12, 50, 200, 1000):
        for at in (20, len(mit) // 2, len(mit) - 12):
            found = scan.find(" ".join(mit[:at] + [f"foreign{i}" for i in range(foreign)] + mit[at:]))
            assert [m.name for m in found] == ["MIT"] and found[0].coverage >= 0.8
    assert [m.name for m in scan.find(" ".join(mit + ["between"] * 30 + mit + mit))] == ["MIT"] * 3
    assert not scan.find("released by many under a law of the land where the court of MIT has no license")
    assert not scan.find("The license was released under pressure. Work is licensed to public version 3 of the general.")
    both = scan.find(f"{licenses.TEMPLATES['Apache-2.0'][0]} words between {licenses.TEMPLATES['MIT'][0]}")
    assert {m.name for m in both} == {"Apache-2.0", "MIT"}


@pytest.mark.parametrize("text", [
    "Released under the BSD License.", "Licensed under the Apache License", "Licensed under the EUPL License", "Licensed under CC BY-NC-ND 4.0.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 4 of the License, or (at your option) any later version.",
])
def test_a_license_is_not_taken_for_another(text):
    scan = licenses.Scanner({k: v for k, v in licenses.TEMPLATES.items() if not k.startswith("AGPL")})
    assert not scan.find(text)


@pytest.mark.parametrize(("text", "name"), [
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), (licenses.TEMPLATES["BSD-3-Clause"][0], "BSD-3-Clause"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
])
def test_near_relatives_are_told_apart(text, name):
    assert [m.name for m in licenses.Scanner().find(text)] == [name]


def test_words_are_ascii():
    assert licenses.words_of("wor\u212a KEY2 \u0130x") == ["wor", "key2", "x"]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + 1 if x == y else 0))
        row = new
    return row[-1]


def test_alignment_of_words_that_occur_once_is_longest():
    rng = random.Random(6)
    for _ in range(100):
        a, b = (rng.sample(range(30), rng.randint(0, 20)) for _ in range(2))
        a, b = [f"w{x}" for x in a], [f"w{x}" for x in b]
        assert len(licenses.align(a, b)) == longest_common(a, b)
    for _ in range(100):
        places = rng.sample(range(40), rng.randint(0, 25))
        assert len(licenses.increasing(places)) == longest_common(places, sorted(places))


def test_templates_of_a_table(spark, docs):
    table = spark.createDataFrame([("own", "You may do with this work what you like today."), ("own", "Do what you like."), (None, "x"), ("y", None)], "name string, text string")
    own = licenses.templates_of(table)
    assert own == {"own": ["Do what you like.", "You may do with this work what you like today."]}
    given = spark.createDataFrame([(1, "we say: you may do with this work what you like today, and more"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.scanned(given, own).orderBy("doc_id").collect()] == [(1, "own"), (2, None)]
    with pytest.raises(ValueError):
        licenses.templates_of(table, most=1)


def test_license_rows(docs, rows, no_docs):
    got = licenses.scanned(docs).collect()
    assert len(got) == len(rows)
    assert [(r.license, r.coverage, r.licenses) for r in got if r.license] == [("MIT", 1.0, "MIT")]
    assert licenses.scanned(no_docs).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path, rows, codecs):
    """Each stage judged on its own input."""
    import corpus_pipeline
    from offerlens.llm import quality
    from test_dedup import near_rows

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]
    plain = [r[:5] for r in rows]
    spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_before, before = docs, [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name == "quality":
            held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
            model = quality.train(docs_before, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 100, 2) if not held(i)], "doc_id long, quality int"))
            scorer = quality.Scorer(model)
            assert Counter(after) == Counter(r for r in before if scorer.score((r[1] or "").encode()) >= 0.5)
            assert 0 < len(after) < len(before)
        elif name == "exact_dedup":
            assert {r[1] or "" for r in after} == {r[1] or "" for r in before} and len(after) == len({r[1] or "" for r in before})
        elif name == "near_dedup":
            assert Counter((r[0], r[1] or "") for r in after) == near_rows(before)
        elif name == "source_mix":
            most, sizes, got = Counter(before), defaultdict(int), defaultdict(int)
            assert set(after) <= set(before) and all(n <= 3 * most[r] for r, n in Counter(after).items())
            for r in before:
                sizes[r[3]] += n_words(r[1])
            for r in after:
                got[r[3]] += n_words(r[1])
            largest = max(n_words(r[1]) for r in before)
            assert all(abs(got[s] - t) <= 2 * largest for s, t in brute_targets(sizes).items())  # whole documents
        else:
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
            library = codecs[1]
            want = Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in before)
            assert Counter((r[0], tuple(r[4])) for r in after) == want
            continue
        assert docs.columns == columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
