"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mizan.llm import common, decontamination, fingerprints, kernels, language_id, line_dedup, near_dedup, packing, substring_dedup, surrogates, token_output, tokens, warc

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def planted(spark):
    """Documents with shared passages, near copies and exact copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6)))
    passages = [[word() for _ in range(n)] for n in (50, 60, 49, 120)]
    base = [word() for _ in range(200)]
    rows = []
    for i in range(160):
        kind = i % 8
        if kind < 3:
            w = [word() for _ in range(rng.randrange(0, 120))]
            for p in rng.sample(passages, rng.randrange(0, 3)):
                at = rng.randrange(len(w) + 1)
                cut = rng.choice([0, 0, 5])
                w[at:at] = p[cut:]
        elif kind < 7:
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
                w[rng.randrange(len(w))] = word()
        else:
            w = passages[3] + passages[3]
        rows.append((i * 3, rng.choice([" ", "\n", "\t"]).join(w)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\tÄé", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    buf, offsets = kernels.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = kernels.words(buf, offsets)
    found = [bytes(buf[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in SPACES.findall(t)]
    assert np.diff(first).tolist() == [len(SPACES.findall(t)) for t in texts]
    h = kernels.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(found))


def test_substrings_by_brute_force(spark):
    df, rows = planted(spark)
    first, want = {}, {}
    for i, t in sorted(rows.items()):
        w = SPACES.findall(t)
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                keep[j : j + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == want and any(0 < n < w for w, n, _ in want.values())


def components_by_brute_force(rows):
    sets = {}
    for i, t in rows.items():
        w = SPACES.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("how", [{}, {"block_bytes": 60_000, "minor": 0}, {"minor": 1}, {"minor": 0}, {"exact": True}, {"exact": True, "minor": 0}])
def test_near_duplicates_by_brute_force(spark, how):
    df, rows = planted(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, **how).collect()}
    want = components_by_brute_force(rows)
    assert got == want and sum(k for _, _, k in want.values()) < len(want) - 20


def test_blocks_have_a_task_each(spark):
    keys = near_dedup.task_keys(spark, 23)
    d = spark.createDataFrame([(i, keys[i]) for i in range(23)], "task int, key int").repartition(23, "key")
    assert sorted(r.p for r in d.select(F.spark_partition_id().alias("p")).collect()) == list(range(23))


def test_near_duplicates_of_driver_rows(spark, small):
    d = documents(spark, small)
    rows = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert got == components_by_brute_force(rows)


def test_threshold_of_matches():
    t = near_dedup.least_matches(64, 0.85)
    rng = np.random.default_rng(1)
    assert 30 < t < 45 and (rng.binomial(64, 0.85, 200_000) < t).sum() <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {i: find(i) for i in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text(" \n\t.,'ab1éß中<|>_-²s", max_size=40))
def test_memo_gives_the_ids_of_encode(text):
    e = tokens.encoder(tokens.default_path())
    assert e.encode(text) == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, e.kind).tobytes()


def test_memo_on_driver_rows(spark, small):
    e = tokens.Encoder(tokens.default_path(), 500)
    for r in documents(spark, small).collect():
        assert e.encode(r.text) == np.asarray(e.tokenizer.encode(r.text, add_special_tokens=False).ids, e.kind).tobytes()
    assert len(e.pieces) <= 500


def test_token_files(spark, small):
    e = tokens.encoder(tokens.default_path())
    start, want = 0, []
    for r in documents(spark, small).orderBy("doc_id").collect():
        n = len(e.ids(r.text, 0))
        want.append((r.doc_id, start, n))
        start += n
    d = documents(spark, small)
    folder = common.new_folder(spark, "test-ids")
    manifest = token_output.write_shards(d, folder, tokens.default_path(), shard_ids=5000)
    assert manifest.count() > 4
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_output.read_shards(manifest).collect())
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2**40), max_size=400), st.lists(st.integers(0, 2**64 - 1), max_size=300)))
def test_elias_fano(values):
    values.sort()
    raw = token_output.EliasFano.build(np.array(values, np.uint64)).dump()
    back = token_output.EliasFano.load(memoryview(raw))
    assert list(back) == values
    assert [back.select(i) for i in range(len(values))] == values
    if len(values) > 100:
        assert len(raw) * 8 < len(values) * (3.5 + np.log2(max(values) / len(values) + 2)) + 700


def test_ids_at_both_ends_of_the_range(spark):
    ends = [-(2**63), -(2**63) + 1, -1, 0, 7, 2**63 - 2, 2**63 - 1]
    assert list(token_output.EliasFano.load(memoryview(token_output.EliasFano.build(np.array([0, 2**63 + 5, 2**64 - 1], np.uint64)).dump()))) == [0, 2**63 + 5, 2**64 - 1]
    for ids in (ends, ends[::6], [*ends, None]):
        out = token_output.token_files(spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string").coalesce(1)).collect()
        assert {r.doc_id for r in out} == set(ids) and len(out) == len(ids)
    one = token_output.Shard(token_output.pack_shard(ends, [np.zeros(1, "<u2")] * len(ends), 2))
    assert [n for n, _, _ in one.docs()] == ends and [one.doc(i)[0] for i in range(len(ends))] == ends


def test_shard_round_trip():
    ids = [np.arange(n, dtype="<u2") for n in (1, 300, 2, 1)]
    s = token_output.Shard(token_output.pack_shard([None, 5, 5, 2**40], ids, 2))
    assert [(n, a, x.tolist()) for n, a, x in s.docs()] == [(n, a, x.tolist()) for n, a, x in zip([None, 5, 5, 2**40], [0, 1, 301, 303], ids, strict=True)]
    assert s.doc(1)[0] == 5 and s.doc(1)[1].tolist() == list(range(300)) and s.doc(3)[1].tolist() == [0]
    with pytest.raises(ValueError, match="length"):
        token_output.Shard(token_output.pack_shard([1], ids[:1], 2) + b"x")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=12))
def test_plan(counts):
    rows = packing.plan(counts, 64)
    used, ranks = {}, {}
    for length, a, b, seq, offset in rows:
        for i in range(b - a):
            used.setdefault(seq + i, []).append((offset, length))
            ranks.setdefault(length, []).append(a + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    # item by item best-fit decreasing opens as many
    room = []
    for length in sorted((x for k, n in counts.items() for x in [k] * n), reverse=True):
        best = min((r for r in room if r >= length), default=None)
        if best is None:
            room.append(64 - length)
        else:
            room.remove(best)
            room.append(best - length)
    assert len(used) == len(room)


def test_pieces_find_their_plan_rows(spark):
    counts = {1: 700, 2: 5, 3: 90, 40: 30, 63: 4, 64: 2}
    rows = packing.plan(counts, 64)
    pieces = [(n, r, "x") for n, many in counts.items() for r in range(many)]
    found = packing.placed(spark.createDataFrame(pieces, "length long, rank long, more string").repartition(3), rows).collect()
    want = {(n, seq + i, offset) for n, a, b, seq, offset in rows for i in range(b - a)}
    assert {(r.length, r.sequence_id, r.offset) for r in found} == want and len(found) == len(pieces) == len(want)
    plan = packing.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rank_from" not in plan  # no join of pieces with plan rows


def test_packing(spark, small):
    d = documents(spark, small)
    e = tokens.encoder(tokens.default_path())
    lengths = {r.doc_id: len(e.ids(r.text, 0)) for r in d.collect()}
    found = packing.pack(d, with_ids=True).collect()
    places, per_doc = {}, {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        assert len(r.ids) == 4 * r.length
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert {k: [x[1:] for x in sorted(v)] for k, v in per_doc.items()} == {k: packing.cut_points(n, 2048) for k, n in lengths.items()}
    assert len(places) <= 1.02 * sum(lengths.values()) / 2048 + 1


def test_fingerprints(spark, small):
    d = documents(spark, small)
    rows = sorted(((r.doc_id, r.text) for r in d.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.with_edited(d).collect()}
    errors = []
    for i, (name, text) in enumerate(rows):
        after, third = rows[(i + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[name]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = (set(kernels.shingle_sets(pa.array([x]))[0].tolist()) for x in (text, edited))
        if len(a) > 400:
            errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert r.near_next == pytest.approx(fingerprints.likeness(fingerprints.from_text(r.fingerprint), fingerprints.from_text(got[rows[(i + 1) % len(rows)][0]].fingerprint)))
    assert np.mean(errors) < 0.05


def test_fingerprints_merge_and_contain():
    w = [f"w{i}" for i in range(6000)]
    a, b, both = fingerprints.sketches(pa.array([" ".join(w[:300]), " ".join(w[290:]), " ".join(w)]))
    assert fingerprints.containment(a, both) > 0.95 and fingerprints.likeness(a, both) < 0.1
    assert len(fingerprints.merged(a, b)) == pytest.approx(len(both), abs=8)
    assert fingerprints.from_text(fingerprints.as_text(a)).tolist() == a.tolist()


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.with_language(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found) and len(found) == d.count()


def test_language_ignores_lang_of_held_out_rows(spark, small):
    d = documents(spark, small)
    swapped = d.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'zz' ELSE lang END AS lang")
    one, two = ([tuple(r) for r in language_id.with_language(x).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()] for x in (d, swapped))
    assert one == two


def test_n_grams_stay_in_their_text():
    texts = pa.array(["Ab, c", "", None, "12", "dÄ"])
    orders, total, letters = language_id.grams(texts)
    assert letters.tolist() == [3, 0, 0, 0, 2]
    alone = [language_id.grams(pa.array([t]))[0] for t in ("Ab, c", "dÄ")]
    for n in range(3):
        h, bounds = orders[n]
        for row, own in ((0, alone[0]), (4, alone[1])):
            a, b = bounds[row]
            x, y = own[n][1][0]
            assert h[a:b].tolist() == own[n][0][x:y].tolist()
    assert total[0] == 6 + 5 + 4


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 600)
    logits = 20.0 * np.eye(3)[np.where(rng.random(600) < 0.7, labels, rng.integers(0, 3, 600))]
    assert language_id.temperature(logits, labels) > 4


def align_by_table(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), min_size=1, max_size=25))
def test_alignment_scores(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    score, start, end = decontamination.align(x, y)
    assert score == align_by_table(a, b) and 0 <= start <= end <= len(a)
    if score:
        assert align_by_table(a[start:end], b) == score


def test_leaks(spark, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    d = documents(spark, small)
    rows = {r.doc_id: r.text for r in d.collect()}
    rng = random.Random(4)
    extra = []
    for k, (name, text) in enumerate(sorted(items.items())[:20]):
        w = text.split()
        for _ in range(len(w) // 8):  # an edited copy
            w[rng.randrange(len(w))] = "edited"
        extra.append((10_000 + k, "before this " + " ".join(w) + " and after", name))
    more = spark.createDataFrame([x[:2] for x in extra], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(d.select("doc_id", "text").union(more), bench, block_bytes=4000).collect()}
    exact = {(i, k) for i, t in rows.items() for k, x in items.items() if x in t}
    edited = {(i, k) for i, _, k in extra}
    assert exact <= found and edited <= found
    assert all(decontamination.align(*[kernels.word_hashes(b, *kernels.words(b, o, kernels.LETTERS)[:2], kernels.LETTERS) for b, o in (kernels.text_bytes(pa.array([x])) for x in (rows.get(i) or dict(x[:2] for x in extra)[i], items[k]))])[0] > 0 for i, k in found)
    assert len(found) <= len(exact) + len(edited) + 3


def test_leaks_of_much_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 40)))) for k in range(40)]
    rows, want = [], set()
    hashes = lambda x: np.array([hash(w) & (2**63 - 1) for w in x.split()], np.uint64)
    for k, text in items:
        for share in (0.2, 0.3, 0.4):
            for _ in range(12 if k % 2 else 1):  # one copy or many
                w = text.split()
                for at in rng.sample(range(len(w)), int(share * len(w))):
                    w[at] = word()
                rows.append((len(rows), f"{word()} {word()} " + " ".join(w) + f" {word()}"))
                kept = {*zip(text.split(), text.split()[1:], text.split()[2:])} & {*zip(w, w[1:], w[2:])}
                if kept and decontamination.align(hashes(rows[-1][1]), hashes(text))[0] >= decontamination.SCORE * decontamination.MATCH * len(w):
                    want.add((rows[-1][0], k))
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 0.9 * len(rows)


def test_recall_of_lone_edited_copies(spark):
    """Against Smith-Waterman of all pairs: one copy of each item, and no other document that holds any of it."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    hashes = lambda x: np.array([hash(w) & (2**63 - 1) for w in x.split()], np.uint64)
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 60)))) for k in range(60)]
    rows, rate = [], {}
    for share in (0.1, 0.2, 0.3, 0.4):
        for _, text in items:
            w = text.split()
            for at in rng.sample(range(len(w)), round(share * len(w))):
                w[at] = word()
            rate[len(rows)] = share
            rows.append((len(rows), " ".join([word() for _ in range(40)] + w + [word() for _ in range(40)])))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    for share in (0.1, 0.2, 0.3, 0.4):
        own = [r for r in rows if rate[r[0]] == share]
        pairs = [(i, k, hashes(t), hashes(x)) for i, t in own for k, x in items]
        scores, _ = decontamination.best_scores([p[2] for p in pairs], [p[3] for p in pairs])
        want = {p[:2] for p, s in zip(pairs, scores.tolist(), strict=True) if s >= decontamination.SCORE * decontamination.MATCH * len(p[3])}
        got = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(own, "doc_id long, text string"), bench).collect()}
        assert len(want) >= 50 and got <= want and len(got) >= 0.95 * len(want), (share, len(want), len(got))


def test_leaks_in_capitals(spark):
    items = [
        (1, "élève très âgé à l'école où ça été écrit déjà"), (2, "größe straße müßig öl äpfel übung grüße fuß schön"), (3, "ñandú señor niño año mañana otoño sueño baño"),
        (4, "ışık ılık kıyı sığ iğne çığ şiş öğün"), (5, "οδος λογος φως ηλιος δρομος τοπος νομος χρονος"),
    ]
    texts = {k: t.upper() for k, t in items} | {6: items[1][1].upper().replace("SS", "ẞ"), 7: items[3][1].replace("i", "İ").upper(), 8: "ganz andere wörter stehen hier in diesem text"}
    got = decontamination.leaks(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in got} == {(k, k, 1.0) for k in range(1, 6)} | {(6, 2, 1.0), (7, 4, 1.0)}


def test_near_stage_with_shared_and_missing_ids(spark, small):
    import corpus_pipeline

    text = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6)}x{i}" for i in range(60))
    near = text(1) + " more"
    rows = [(5, text(1)), (5, text(2)), (5, text(2)), (3, text(2) + " more"), (5, near), (None, text(3)), (None, text(4)), (None, text(3) + " more"), (None, near), (7, text(5)), (8, text(5))]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in out)
    assert got == sorted((str(i), t.split()[0]) for i, t in [(5, text(1)), (3, text(2)), (None, text(3)), (None, text(4)), (7, text(5))])


def test_near_stage_links_from_four_fifths(spark, small):
    import corpus_pipeline

    w = [f"w{i}" for i in range(104)]  # 100 shingles
    alike = lambda n: " ".join(w[: 104 - n] + [f"other{i}" for i in range(n)])
    rows = [(1, " ".join(w)), (2, alike(11)), (3, alike(30))]  # 89 of 111 shingles in common, and 70 of 130
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert sorted(r.doc_id for r in out) == [1, 3]


def test_leaks_of_short_items(spark):
    long = "one two three four five six seven eight nine ten"
    items = [(1, "Wie alt ist Zoë?"), (2, "今天天气怎么样"), (3, "wie alt ist zoë"), (4, "a b c d e f g"), (5, None), (6, " ?"), (7, long)]
    rows = [(1, "so: WIE ALT IST ZOË, wie alt ist Zoë"), (2, "a: 今天天气怎么样?"), (3, "wie alt ist"), (4, "Zoë wie alt"), (5, "a b c d e f"), (6, "x a b c d e f g"), (7, "ist zoë"), (8, None), (9, long), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    run = lambda some: {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in decontamination.leaks(docs, spark.createDataFrame(some, "item_id long, text string")).collect()}
    short = {(1, 1, 1.0, 1, 5), (1, 3, 1.0, 1, 5), (6, 4, 1.0, 1, 8), (None, 4, 1.0, 0, 7), (2, 2, 1.0, 1, 2)}
    assert run(items[:6]) == short and run(items) == short | {(9, 7, 1.0, 0, 10)}


def test_leaks_of_a_very_long_item(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(1500)]
    edited = [word() if rng.random() < 0.2 else w for w in item]
    rows = [(1, " ".join([word(), *edited, word()])), (2, " ".join(item[:300])), (3, " ".join(item[400:1200])), (4, " ".join(word() for _ in range(1500)))]
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item))], "item_id long, text string"), block_bytes=1000).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 9), (1, 9), (3, 9), (3, 9)]
    assert {(r.first_word, r.last_word) for r in got if r.doc_id == 3} == {(0, 800)}


def test_best_scores_equal_single_alignments():
    rng = np.random.default_rng(3)
    passages = [rng.integers(2, 9, n).astype(np.uint64) for n in rng.integers(1, 60, 300)]
    items = [rng.integers(2, 9, n).astype(np.uint64) for n in rng.integers(8, 30, 300)]
    want = [decontamination.align(p, i)[0] for p, i in zip(passages, items, strict=True)]
    scores, at = decontamination.best_scores(passages, items)
    assert scores.tolist() == want and not at.any()
    assert decontamination.best_scores([], [])[0].tolist() == []


def test_windows_of_long_passages_lose_no_alignment():
    rng = np.random.default_rng(4)
    for n, alphabet in ((700, 6), (3000, 40), (2000, 400)):
        passages = [rng.integers(2, alphabet, n).astype(np.uint64) for _ in range(6)]
        items = [rng.integers(2, alphabet, m).astype(np.uint64) for m in (8, 9, 20, 30, 60, 100)]
        for p, own in zip(passages[3:], items[3:], strict=True):  # an edited copy across the windows' bounds
            a = int(rng.integers(100, n - 200))
            copy = np.insert(own, rng.integers(0, len(own), len(own) // 4), 1)
            p[a : a + len(copy)] = copy
        scores, at = decontamination.best_scores(passages, items)
        for p, own, score, first in zip(passages, items, scores.tolist(), at.tolist(), strict=True):
            want = decontamination.align(p, own)
            end = next(b for a, b in decontamination.windows(len(p), len(own)) if a == first)
            got = decontamination.align(p[first:end], own)
            assert score == want[0] == got[0] and (first + got[1], first + got[2]) == want[1:]


def test_a_very_long_passage_takes_bounded_memory():
    rng = np.random.default_rng(6)
    items = [rng.integers(2, 10**6, 30).astype(np.uint64) for _ in range(2001)]
    passages = [np.tile(items[0], 10_000), *[np.roll(i, 3) for i in items[1:]]]
    tracemalloc.start()
    scores, _ = decontamination.best_scores(passages, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and scores[0] == 60 and (scores[1:] == 54).all()


def test_lines_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    first, later = {}, {}
    for i, t in rows:
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            key = tuple(ls[p : p + 3])
            if "".join(key).strip(" ") and first.setdefault(key, (i, p)) != (i, p):
                later.setdefault(i, set()).update((p, p + 1, p + 2))
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in later.get(i, ())) for i, t in rows}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_archive_damage():
    w = warc.Writer(sample_bytes=2000)
    for i in range(40):
        w.add(warc.record(i, "http://x/ü", f"<p>seite {i}</p>".encode() * 5, i - 1 if i % 7 == 1 else None, "2024-01-01T00:00:00Z"))
    data = w.finish()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    records = [warc.parse(c, "x") for _, c in warc.frames(data, "x")]
    assert len(records) == 40 and sum(h["warc-type"] == "revisit" for h, _ in records) == 6
    for bad in (data[:-3], data[8:], data[:-1] + b"\0", data + b"tail", b"", data[:100]):
        with pytest.raises(ValueError, match="x"):
            list(warc.frames(bad, "x"))
    good = warc.record(1, "u", b"p", None, "d")
    for bad in (good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"WARC-Date", b"X-Date"), good[:-2], b"HTTP/1.1 200 OK\r\n\r\n", good.replace(b"WARC-Type:", b"WARC-Type ")):
        with pytest.raises(ValueError, match="x"):
            h, block = warc.parse(bad, "x")
            warc.payload_of(h, block, "x")
    h, block = warc.parse(good.replace(b"\r\n\r\np", b"\r\n\r\nq"), "x")
    with pytest.raises(ValueError, match="digest"):
        warc.payload_of(h, block, "x")


def test_archives(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    manifest = warc.write_archives(pages, common.new_folder(spark, "test-warc"), archive_bytes=20_000)
    assert manifest.count() > 1
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_archives(manifest).where("payload IS NOT NULL").collect()}
    want = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert got == {k: want[k] for k in got} and len(got) >= len(set(x[1] for x in want.values()))


MENTIONS = [
    (1, "Yaz: Ali.Can42@Mail.example.com ya da +1 (415) 555-0132, kart 4111 1111 1111 1111, adres 85.12.3.204."),
    (2, "ali.can42@mail.example.com again; +1-415-555-0132; 4111-1111-1111-1111 and 85.12.3.204"),
    (3, "Mr. John Smith met Mrs. Jane Smith. Mr. Smith left. Господин Иван Петров."),
    (4, 'token = "0a1b2c3d4e5f60718293" password=hunter2hunter2'),
    (6, "IBAN DE89 3704 0044 0532 0130 00, wrong DE88 3704 0044 0532 0130 00, SSN 123-45-6789 and 000-12-3456"),
    (5, "No data: 1234 5678 9012 3456, version 1.2.3.4.5, Mr and 12:30."),
]


def test_surrogates(spark):
    out = {r.doc_id: r for r in surrogates.with_surrogates(spark.createDataFrame(MENTIONS, "doc_id long, text string"), b"k1").collect()}
    kinds = {i: [e.type for e in r.entities] for i, r in out.items()}
    assert kinds == {1: ["email", "phone", "card", "ipv4"], 2: ["email", "phone", "card", "ipv4"], 3: ["name-m", "surname", "name-f", "surname", "surname", "name-m", "surname"], 4: ["secret", "secret"], 5: [], 6: ["iban", "ssn"]}
    assert out[5].text == MENTIONS[5][1]
    account = out[6].entities[0].surrogate
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", account) and surrogates.account_remainder("DE", account[2:4], account[4:].replace(" ", "")) == 1
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[6].entities[1].surrogate) and "DE88 3704 0044 0532 0130 00" in out[6].text and "000-12-3456" in out[6].text
    one, two = ({e.type: e.surrogate for e in out[i].entities} for i in (1, 2))
    assert one["email"].lower() == two["email"] and one["ipv4"] == two["ipv4"]
    assert re.sub(r"\D", "", one["card"]) == re.sub(r"\D", "", two["card"]) and re.sub(r"\D", "", one["phone"]) == re.sub(r"\D", "", two["phone"])
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", one["card"]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one["phone"])
    digits = re.sub(r"\D", "", one["card"])
    assert digits[-1] == surrogates.check_digit(digits[:-1])
    names = [e.surrogate for e in out[3].entities]
    assert names[1] == names[3] == names[4] and names[0] != names[2] and re.fullmatch("[А-Я][а-я]+", names[5])
    for _, text in MENTIONS[:5]:
        for part in ("Can42", "can42", "555-0132", "1111 1111", "85.12.3.204", "Smith", "John", "Петров", "hunter2", "0a1b2c"):
            assert not any(part in r.text for r in out.values()) or part not in text
    other = {r.doc_id: r.text for r in surrogates.with_surrogates(spark.createDataFrame(MENTIONS, "doc_id long, text string"), b"k2").collect()}
    assert other[1] != out[1].text


def test_surrogates_stay_distinct_in_a_crowded_format(spark):
    rows = [(i, f"host 1.1.{a}.{b} up") for i, (a, b) in enumerate((a, b) for a in range(1, 10) for b in range(1, 10))]
    rows += [(1000 + i, f"host {a}.{b}.{c}.{d} up") for i, (a, b, c, d) in enumerate((a, b, c, d) for a in range(1, 10) for b in range(1, 10) for c in range(2, 10) for d in range(1, 8))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    real = {t.split()[1] for _, t in rows}
    for few in (surrogates.FEW, 0):
        out = surrogates.with_surrogates(d, few=few).collect()
        new = [r.entities[0].surrogate for r in out]
        assert len(set(new)) == len(real) and not set(new) & real


NAMED = [
    (1, "Mr. McDonald met Herr Jean-Pierre Müller. Dr. Anna Bell; John Smith wrote to Jane Doe."),
    (2, "MR. JOHN SMITH's car. Smith left, and so did O'Brien. Mr. O'Brien, Frau Sokolović, Herr Yılmaz, Mrs. Şahin, Mr. Łukasz Nowak"),
    (3, "Госпожа Петрова, Господин Петров. Pan Kowalski. Frau Kowalska und Herr Kowalski"),
    (4, "call 0532 123 45 67 or +44 20 7946 0958 0161 496 0000, 2001:db8::8a2e:370:7334 at 12:30:45 in std::vector"),
]


def test_whole_names_and_local_numbers(spark):
    out = {r.doc_id: r for r in surrogates.with_surrogates(spark.createDataFrame(NAMED, "doc_id long, text string"), b"k").collect()}
    texts = dict(NAMED)
    found = {i: [texts[i][e.start : e.end] for e in r.entities] for i, r in out.items()}
    assert found[1] == ["McDonald", "Jean-Pierre", "Müller", "Anna", "Bell", "John", "Smith", "Jane", "Doe"]
    assert found[2] == ["JOHN", "SMITH", "Smith", "O'Brien", "O'Brien", "Sokolović", "Yılmaz", "Şahin", "Łukasz", "Nowak"]
    assert found[3] == ["Петрова", "Петров", "Kowalski", "Kowalska", "Kowalski"]
    assert found[4] == ["0532 123 45 67", "+44 20 7946 0958", "0161 496 0000", "2001:db8::8a2e:370:7334"]
    new = {i: [e.surrogate for e in r.entities] for i, r in out.items()}
    assert new[2][0] == new[1][5].upper() and new[2][1] == new[1][6].upper() and new[2][2] == new[1][6]
    assert new[2][3] == new[2][4] and re.fullmatch("[A-Z][a-z]+'[A-Z][a-z]+", new[2][3]) and re.fullmatch("[A-Z][a-z]+-[A-Z][a-z]+", new[1][1])
    assert new[3][0] == new[3][1] + "а" and new[3][1].endswith("ов") and new[3][2] == new[3][4] and new[3][3] == new[3][2][:-1] + "a"
    assert re.fullmatch(r"0\d{3} \d{3} \d{2} \d{2}", new[4][0]) and ":" in new[4][3]
    originals = {w for f in found.values() for w in f}
    assert not any(w in r.text for r in out.values() for w in originals if len(w) > 3)


def test_a_full_network_ends(spark):
    addresses = [f"192.168.{a}.{b}" for a in range(1, 255) for b in range(1, 255)]
    d = spark.range(len(addresses)).select(F.col("id").alias("doc_id"), F.concat(F.lit("at 192.168."), (F.col("id") / 254 + 1).cast("int"), F.lit("."), F.col("id") % 254 + 1).alias("text"))
    out = surrogates.with_surrogates(d).select("entities").collect()
    new = [r.entities[0].surrogate for r in out]
    assert len(new) == len(set(new)) == len(addresses) == 64_516 and not set(new) & set(addresses)


def test_names_of_all_kinds_stay_distinct_and_agree(spark):
    letters = "bcdfglmnprst"
    words = [a.upper() + v + b for a in letters for v in "aeiou" for b in letters]
    rows = [(i, f"Mr. {w} and Mrs. {w} {words[-i - 1]}") for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    every = {}
    for r in surrogates.with_surrogates(d, b"k").collect():
        for e in r.entities:
            every.setdefault((e.type, rows[r.doc_id][1][e.start : e.end]), set()).add(e.surrogate)
    assert all(len(x) == 1 for x in every.values())
    values = [next(iter(x)) for x in every.values()]
    assert len(values) == len(set(values)) >= len(words) and not set(values) & set(words)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{source}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, source).collect()
    # by brute force: line dedup over all documents (each has a likely language), then copies, then leaks
    first, gone = {}, {}
    for i, t in sorted(docs.items()):
        ls = t.split("\n")
        for p in range(len(ls) - 2):
            key = tuple(ls[p : p + 3])
            if "".join(key).strip(" ") and first.setdefault(key, (i, p)) != (i, p):
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in docs.items() if len(gone.get(i, ())) < len(t.split("\n"))}
    left = {i: left[i] for i, (_, _, kept) in components_by_brute_force(left).items() if kept}
    clean = {i for i, t in left.items() if not any(x in t for x in items)}
    got = {r.doc_id for r in found}
    assert got <= clean and len(clean - got) <= 2
    e = tokens.encoder(tokens.default_path())
    assert {r.doc_id: 0 for r in found}.keys() == got and sum(r.length for r in found) == sum(len(e.ids(left[i], 0)) for i in got)


@pytest.mark.parametrize("name", ["op2_warc_zstd", "op3_substring_dedup", "op7_minhash_near_dedup", "op10_line_dedup"])
def test_matches_sql(spark, small, name):
    import duckdb

    from mizan.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    other = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[columns.index(c)] for c in order]) for r in other.fetchall())
