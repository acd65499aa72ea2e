"""Each operator against a plain version of what it computes, and on odd tables."""

import collections
import hashlib
import itertools
import random
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import bpe, byte_units, chat, decontaminate, html_text, ngram_join, quality, token_output
from palimpsest.llm.common import shingles
from palimpsest.llm.oracles import ORACLES
from palimpsest.llm.queries import QUERIES
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
ODD = [(1, "Alpha beta gamma delta epsilon zeta eta"), (1, "Alpha beta gamma delta epsilon zeta eta"), (2, None), (3, ""), (None, "null id here, six words long"), (None, None), (4, LONG), (5, "x" * 200_000), (6, "  \n\t "), (7, "tie"), (7, "other tie"), (8, "é ß ﬁ 日本 😀 <|endoftext|> <|startoftext|>")]
PIECES = [" ", "  ", "\n", "\t", "a", "b", "Th", "é", "ñ", "Σ", "ΑΣ", "'s", "'LL", "1", "23", "٣", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", "　", "!", "--", "İ", "ß", "中", "𝒳", "​", "\x00", "ſ", "̀", ".", "\r\n"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


def table(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "src0", 0, "x", 1.5, "y") for i, t in rows], SCHEMA + ", row string, score double, words string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


# 1


def canonical(text):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(nfkc(nfkc(text).casefold()).split())


def plain_fingerprints(rows):
    """Rows in order of id and what they are compared with."""
    out = []
    for k, (i, t) in enumerate(rows):
        n, after = len(t), rows[(k + 1) % len(rows)][1]
        q = n // 4
        edited = t[: n - q] + after[:q]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), canonical(t), canonical(edited), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after))))
    return out


def assert_fingerprints(got, want):
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got] == [(w[0], w[1], w[2], w[5], w[6]) for w in want]
    by = collections.defaultdict(set)
    for r, w in zip(got, want):
        by[w[3]].add(r.fingerprint)
        by[w[4]].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({f for x in by.values() for f in x}) == len(by)


def test_fingerprints(spark, sf, docs):
    got = QUERIES["op1_fingerprints"](spark, sf).orderBy("doc_id").collect()
    assert_fingerprints(got, plain_fingerprints(sorted(texts_of(docs).items())))


def test_fingerprints_of_odd_texts(spark):
    from palimpsest.llm.fingerprints import compare_edited

    rows = [(1, "ﬁ Straße  Á"), (2, "fi strasse á"), (5, ""), (9, "😀😀😀😀"), (2**62, "  x　Y ")]
    assert_fingerprints(compare_edited(table(spark, rows)).orderBy("doc_id").collect(), plain_fingerprints(rows))
    got = compare_edited(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert compare_edited(table(spark, ODD[:1])).first().near_next == 1.0 and compare_edited(table(spark, ODD[:0])).count() == 0


# 2


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.85


def test_quality_is_calibrated_to_the_odds_of_all_labels(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").where(~quality.held_out())
    n = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    odds = n[1] / n[0]
    few, most = (quality.fit(docs, labels, most_rows=k).prior for k in (n[0], 1500))
    assert few == pytest.approx(odds / (1 + odds)) == most
    rows = [(f"{w} {i} " * 40, y) for i in range(40) for w, y in (("alpha beta", 1), ("zzz", 0))]
    even, fewer_bad = quality.fit_texts(rows), quality.fit_texts(rows, sampled=(1.0, 0.25))
    assert fewer_bad.offset - even.offset == pytest.approx(np.log(4)) and fewer_bad.slope == even.slope


def test_scores_equal_brute_force(spark, docs, sf):
    """The dictionaries hold a part of every second labelled text, and a score is one curve over one size difference."""
    import zstandard

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = texts_of(docs)
    kinds = {k: [rows[i] for i in sorted(rows) if labels.get(i) == k and rows[i]] for k in (0, 1)}
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    packers = {}
    for k, data in ((0, model.bad), (1, model.good)):
        share = 112_640 // len(kinds[k][::2]) - 1
        assert data == b"\n".join((b := t[max(0, (len(t) - 32768) // 2) :][:32768].encode())[max(0, (len(b) - share) // 2) :][:share] for t in kinds[k][::2])
        packers[k] = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)

    def difference(t):
        data, sums, n = t.encode(), {0: 0, 1: 0}, 0
        for i in range(0, len(data) or 1, 1024):
            n += len(data[i : i + 1024]) + 16
            for k, p in packers.items():
                sums[k] += len(p.compress(data[i : i + 1024]))
        return (sums[0] - sums[1]) / n

    used = [(difference(t), k) for k in (0, 1) for t in kinds[k][1::2]]
    loss = lambda a, b: sum(np.logaddexp(0, -(a + b * x) * (2 * y - 1)) for x, y in used)
    best = loss(model.offset, model.slope)
    assert all(loss(model.offset + da, model.slope * (1 + db)) > best - 0.01 for da in (-0.1, 0, 0.1) for db in (-0.1, 0, 0.1))
    for r in quality.score(docs, model).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.offset + model.slope * difference(rows[r.doc_id])))), abs=1e-6)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(table(spark, ODD), labels)
    assert [r.score for r in quality.score(table(spark, ODD), model).collect()] == [1.0] * len(ODD)
    assert quality.score(table(spark, []), model).count() == 0


def test_quality_of_odd_texts(spark, docs, sf):
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.score(table(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert quality.accepted(table(spark, ODD), model).columns == table(spark, ODD).columns


# 3, 7 and 9


def plain_ids(name, texts):
    return [e.ids for e in byte_units.load(name).encode_batch(texts, add_special_tokens=False)]


KEPT = byte_units.Pieces("byte_bpe_50k.json", together=3)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_give_the_ids_of_the_library(text):
    for pieces in (byte_units.Pieces("byte_bpe_50k.json", most_bytes=2000), KEPT):  # one that forgets, one that knows words of other texts
        texts = [text, "", text[::-1], text]
        want = plain_ids("byte_bpe_50k.json", texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.encode(texts)] == want
        assert pieces.lengths(texts) == list(map(len, want))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_merges_give_the_ids_of_the_library(text):
    coder, lib = bpe.coder("word_bpe_49k.json"), byte_units.load("word_bpe_49k.json")
    ids = lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
    assert coder.decode(coder.encode(text)) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=2500), st.integers(0, 2500), st.integers(0, 2500))
def test_blocks_are_invertible(values, first, count):
    ids = np.array(values, dtype=np.uint32)
    starts, payload = token_output.pack(ids)
    assert (token_output.unpack(starts, payload) == ids).all()
    assert token_output.unpack_range(starts, payload, first, count).tolist() == values[first : first + count]


def test_exceptions_keep_blocks_narrow():
    ids = np.full(1024, 7, dtype=np.uint32)
    ids[::100] = 2**31
    assert len(token_output.pack_block(ids)) < 100


def test_token_files(spark, sf, docs):
    got = QUERIES["op3_token_output"](spark, sf).orderBy("doc_id").collect()
    rows, start = sorted(texts_of(docs).items()), 0
    for r, (i, ids) in zip(got, zip([i for i, _ in rows], plain_ids("byte_bpe_50k.json", [t for _, t in rows])), strict=True):
        ids = [*ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_texts(spark):
    got = sorted(token_output.token_output(table(spark, ODD)).collect(), key=lambda r: r.start)
    assert len(got) == len(ODD) and [r.doc_id for r in got][:2] == [None, None] and got[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got))
    assert token_output.token_output(table(spark, [])).count() == 0


def test_counts_and_bpe(spark, sf, docs):
    from palimpsest.llm.token_counts import count_tokens

    for source in (docs, table(spark, ODD)):
        rows = [(r.doc_id, r.text or "") for r in source.collect()]
        want = [(i, len(t.encode()), len(x), len(x) > 512) for (i, t), x in zip(rows, plain_ids("byte_bpe_50k.json", [t for _, t in rows]))]
        assert collections.Counter(map(tuple, count_tokens(source).collect())) == collections.Counter(want)
        lib = byte_units.load("word_bpe_49k.json")
        want = [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, plain_ids("word_bpe_49k.json", [t for _, t in rows]))]
        assert collections.Counter(map(tuple, bpe.encode_decode(source).collect())) == collections.Counter(want)
    assert count_tokens(table(spark, [])).count() == 0 == bpe.encode_decode(table(spark, [])).count()
    full = bpe.encode_decode(table(spark, ODD[-1:]), outputs=True).first()
    assert len(full.ids) == full.n_tokens and "</w>" in full.decoded


# 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", "\n", "/s>"]), max_size=8).map("".join)] * 2), max_size=4))
def test_formatting_is_invertible(turns):
    out = "".join(chat.render(*t) for t in turns)
    assert [(role, text) for role, text, _, _ in chat.parse(out)] == turns
    assert not any(c in chat.escape(text) for _, text in turns for c in chat.CONTROL)


def test_events_fold_into_messages(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", None, "llo"), (1, 3, 2, "message", "user", "more"), (1, 4, 3, "delta", "assistant", "old"),
        (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "new"), (1, 7, 2, "message", "user", "again"), (1, 8, 2, "edit", None, "edited"),
        (2, 0, 0, None, None, None), (None, 0, 0, "message", "user", "x"), (3, 0, 0, "message", "user", "same"), (3, 0, 0, "message", "user", "same"),
    ]
    df = spark.createDataFrame([(*e, "z") for e in events], "conv_id long, seq long, message long, kind string, role string, text string, formatted string").repartition(3)
    got = collections.defaultdict(list)
    for r in chat.format_chats(df).orderBy("conv_id", "position").collect():
        got[r.conv_id].append((r.role, r.text))
        assert r.role != "assistant" or r.formatted[r.loss_start : r.loss_end] == chat.escape(r.text)
    assert got == {1: [("user", "hi"), ("assistant", "new"), ("user", "edited")], 2: [("", "")], None: [("user", "x")], 3: [("user", "same")] * 2}
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


# 5


def plain_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or sets[a] and sets[b] and both >= threshold * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    return links


def test_links_of_near_copies(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(240):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, 8)):
            words[r.randrange(len(words))] = f"v{r.randrange(9000)}"
        rows.append((i, " ".join(words)))
    links = plain_links(rows)
    got = {x.doc_id: x for x in ngram_join.ngram_join(table(spark, rows), block_texts=16).collect()}
    assert {i: got[i].n_links for i, _ in rows} == {i: len(links[i]) for i, _ in rows}
    group = {i: {i} | links[i] for i, _ in rows}
    while (wider := {i: set().union(*(group[j] for j in own)) for i, own in group.items()}) != group:
        group = wider
    assert {i: got[i].class_id for i, _ in rows} == {i: min(own) for i, own in group.items()}
    kept = {x.doc_id for x in ngram_join.one_of_each(table(spark, rows)).collect()}
    assert kept == {min(own) for own in group.values()}


def test_large_classes_are_dealt_apart(spark, monkeypatch):
    rows = [(i, f"one two three four five six seven {i // 20}") for i in range(60)] + ODD
    want = sorted(map(str, ngram_join.ngram_join(table(spark, rows)).collect()))
    monkeypatch.setattr(ngram_join, "HOT", 3)
    assert sorted(map(str, ngram_join.ngram_join(table(spark, rows)).collect())) == want and len(want) == len(rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components(spark, edges):
    from palimpsest.llm.graph import components

    edges += [(50, i) for i in range(60, 75)]  # a star
    group = {x: {x} for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: min(own) for x, own in group.items()} and len(got) == len(group)


def test_join_of_odd_texts(spark):
    got = ngram_join.ngram_join(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert [r.n_links for r in got if r.doc_id == 1] == [1, 1] and {r.n_copies for r in got if r.doc_id == 3} == {4}
    assert ngram_join.one_of_each(table(spark, ODD)).columns == table(spark, ODD).columns
    assert ngram_join.ngram_join(table(spark, [])).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.needed(0.8, 1e-6)
    r = np.random.default_rng(1)
    matches = np.cumsum(r.random((20_000, ngram_join.HASHES)) < 0.8, axis=1)
    checks = np.arange(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP)
    assert (matches[:, checks - 1] >= np.array(least)[checks]).all() and least[ngram_join.HASHES] > 90


# 6


def test_license_scan(spark):
    from palimpsest.llm.license_scan import SENTENCES, scan

    mit = next(iter(SENTENCES))
    words = mit.split()
    rows = [(1, "The MIT license, mit-License; APACHE\nLICENSE"), (2, mit.upper()), (3, " ".join([*words[:9], "really", *words[9:]])), (4, "mit xlicense ccby cc  by"), (5, "GNU General Public Licenses"), (6, "ÀGNU general public license"), *[(10 + k, t) for k, (_, t) in enumerate(ODD)]]
    got = {r.doc_id: r for r in scan(table(spark, rows)).collect()}
    assert tuple(got[1]) == (1, 7, 3, 1, 5, "apache,mit", "apache,mit", 1.0)
    assert (got[2].n_base, got[2].labels, got[2].score) == (0, "mit", 1.0) and got[3].labels == "mit" and 0.6 < got[3].score < 1
    assert (got[4].n_base, got[4].first_word, got[4].base_labels) == (1, 3, "cc-by") and got[5].n_base == 0 == got[6].n_base
    assert got[12].n_words == 0 and got[16].n_words == 60_000 and len(got) == len(rows)
    assert scan(table(spark, ODD)).count() == len(ODD) and scan(table(spark, [])).count() == 0
    twice = scan(table(spark, [(1, "gnu general public license " + mit)] * 3 + [(1, "mit license")]).repartition(3)).collect()
    assert sorted((r.n_base, r.labels) for r in twice) == [(1, "gpl,mit")] * 3 + [(1, "mit")]
    long = " ".join(f"w{i}" for i in range(300))
    assert [r.labels for r in scan(table(spark, [(1, f"a {long} b")]), {}, {long: "long"}).collect()] == ["long"]


def test_sibling_licenses(spark):
    from palimpsest.llm.license_scan import SENTENCES, scan

    by = {label: sentence for sentence, label in SENTENCES.items()}
    rows = [(i, sentence) for i, sentence in enumerate(by.values())]
    rows += [(20, f"{by['gpl']} {by['lgpl']}"), (21, f"{by['cc-by-sa']} and {by['cc-by']}"), (22, f"{by['lgpl']} " * 50 + by["mit"])]
    got = {r.doc_id: {x for x in r.labels.split(",")} - {x for x in r.base_labels.split(",") if x and x not in ("apache", "gpl")} for r in scan(table(spark, rows)).collect()}
    want = {i: {label} for i, label in enumerate(by)} | {20: {"gpl", "lgpl"}, 21: {"cc-by", "cc-by-sa"}, 22: {"lgpl", "mit"}}
    assert got == want


# 8


def test_leaks(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randrange(12, 60)))) for i in range(40)] + [(90, "short one"), (91, ""), (92, None)]
    rows, want = [], set()
    for i in range(200):
        words = [word() for _ in range(r.randrange(1, 300))]
        if i % 4 == 0:
            item, text = r.choice(items[:40])
            passage = text.split()
            if i % 8 == 0 and len(passage) > 50:
                passage[-1] = "changed"  # loses one shingle of at least 46
            if i % 8 == 0 or len(passage) <= 50:
                at = r.randrange(len(words) + 1)
                words[at:at] = [w.upper() + "," for w in passage]
                want.add((i, item))
        rows.append((i, " ".join(words)))
    rows.append((500, "a Short one."))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(table(spark, rows), benchmark)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want | {(500, 90)}
    split = decontaminate.find_leaks(table(spark, rows), benchmark.withColumns({"doc_id": F.lit(1), "similarity": F.lit("z")}), block_bytes=2000)
    assert {tuple(x) for x in split.collect()} == {tuple(x) for x in got.collect()}
    split = decontaminate.without_leaks(table(spark, rows), benchmark, block_items=20)
    assert {x.doc_id for x in split.collect()} == {i for i, _ in rows} - {i for i, _ in want} - {500}
    assert {x.doc_id for x in decontaminate.without_leaks(table(spark, rows), benchmark).collect()} == {i for i, _ in rows} - {i for i, _ in want} - {500}
    assert decontaminate.find_leaks(table(spark, ODD), benchmark).count() == 0 == decontaminate.find_leaks(table(spark, []), benchmark).count()
    assert decontaminate.without_leaks(table(spark, ODD), benchmark.limit(0)).count() == len(ODD)


def test_windows_equal_brute_force():
    """Every window of an item's length that reaches the threshold is found by the Hamming index."""
    r = random.Random(3)
    text = " ".join(f"w{r.randrange(6)}" for _ in range(400))
    words = text.split()
    own = [" ".join(words[a : a + 30]) for a in (10, 200, 333)]
    own[1] = own[1].replace("w3", "w4", 1)
    index = decontaminate.Items(list(range(3)), own, 0.8, 31, 5)
    got = {f[0]: f[4] for f in index.search(text)}
    hashes = decontaminate._words.of(text)
    for i, x in enumerate(own):
        item = collections.Counter(shingles(decontaminate._words.of(x)).tolist())
        best = max(decontaminate.weighted_similarity(collections.Counter(shingles(hashes[a : a + 30]).tolist()), item) for a in range(371))
        assert (best >= 0.8 and got[i] == pytest.approx(best)) or (best < 0.8 and i not in got)


def test_recall_and_pass_rate_of_the_index():
    """Windows edited to a similarity of 0.8 and more are within the radius; the blocks let few random pairs pass."""
    r = np.random.default_rng(11)
    items = [r.integers(1, 1 << 63, n, dtype=np.uint64) for n in (46, 96, 196) for _ in range(40)]
    for low, least in ((0.8, 0.985), (0.9, 0.999), (0.95, 1.0)):
        found = []
        for own in items:
            changed = int(len(own) * (1 - low) / (1 + low))  # of n shingles in both windows: (n - c) / (n + c) stay common
            for _ in range(10):
                other = own.copy()
                other[r.choice(len(own), changed, replace=False)] = r.integers(1, 1 << 63, changed, dtype=np.uint64)
                a, b = (decontaminate.packed(decontaminate.signs(x).sum(axis=0, keepdims=True)) for x in (own, other))
                found.append(decontaminate.distances(a, b)[0] <= 31)
        assert np.mean(found) >= least
    texts = [" ".join(f"w{r.integers(1 << 40)}" for _ in range(50)) for _ in range(64)]
    index = decontaminate.Items(list(range(64)), texts, 0.8, 31, 5)
    prints = r.integers(0, 1 << 16, (2000, 8), dtype=np.uint16)
    rows, own, columns = index.groups[5]["lengths"][46]
    passed = np.bitwise_or.reduce([index.near[b, prints[:, b], columns] for b in range(8)])
    assert np.unpackbits(passed, axis=1, count=64).mean() < 0.1 and len(own) == 64
    near = own.copy()  # every fingerprint within the radius is found
    for row in near:
        for bit in r.choice(128, 31, replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    assert {(a, b) for a, b, _ in zip(*index.candidates(near, (rows, own, columns)))} >= {(i, i) for i in range(64)}


def test_leaks_query(spark, sf, docs):
    """Against all windows of all documents, by plain counting."""
    rows, items = texts_of(docs), {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    words = lambda t: [w for w in (x.strip(decontaminate.ENDS).lower() for x in t.split()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))]
    wanted, of = {i: collections.Counter(grams(words(t))) for i, t in items.items()}, collections.defaultdict(set)
    for i, c in wanted.items():
        for g in c:
            of[g].add(i)
    want = {}
    for d, t in rows.items():
        own = grams(words(t))
        for i in set().union(*(of[g] for g in own if g in of)):
            n = sum(wanted[i].values())
            best = max(decontaminate.weighted_similarity(collections.Counter(own[a : a + n]), wanted[i]) for a in range(max(1, len(own) - n + 1)))
            if best >= 0.8:
                want[d, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert got == pytest.approx(want) and got


# 10


PAGE = """<html><body class=x><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div id="cookie-notice">We use cookies, many of them</div>
<div id=wrap><div class="content"><div class=part><p>First long paragraph &amp; text is here, really.<p>Second&nbsp;one <b>bold<br>next</b>  line</div>
<div class=part><h2>Head</h2><p>Third with <a href=x>one link</a> inside, and text.</p><ul><li>one<li>two</ul></div></div><aside>side bar text of some length to be a danger</aside></div>
<section id=comments><p>Reader one: nice article, thank you very much indeed</p></section><script>var a="<p>no</p>";</script><form><p>Subscribe <input></form><!-- <p>no</p> --><footer>(c) me</footer></body>"""


def test_page_without_article():
    assert html_text.main_text(PAGE).split("\n") == ["First long paragraph & text is here, really.", "Second one bold next line", "Head", "Third with one link inside, and text.", "one", "two"]


@pytest.mark.parametrize(("page", "want"), [("", ""), ("just &lt;b&gt; <i>x</i>", "just <b> x"), ("<p>a<p>b", "a\nb"), ("<script>x<y", ""), ("<article><p>a</article><nav>b", "a"), ("<!-- open <p>x", ""), ("<div class='has-sidebar'><article><p>a</article><div class=comments><article><p>reader</article></div></div>", "a"), ("a < b", "a < b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div>" * 5000 + "deep", "deep")])
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


LONG = "A long sentence of the main text, with many words enough in it to be no furniture at all, and it goes on and on for some good while yet."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{LONG}<h2 id=related-work>Related work</h2><p>x<section id=social-impact><p>{LONG}</section><p class=notice-of-hearing>On 5 May.<div class=share>Share this</div><div class=related-posts><a href=x>Other story</a></div></article>", [LONG, "Related work", "x", LONG, "On 5 May."]),
        (f"<body><div class='content has-sidebar'><p>{LONG}<p>Two {LONG}</div><footer>f</footer>", [LONG, f"Two {LONG}"]),
        (f"<body><div class=sidebar><p>{LONG}<p>Two {LONG}</div>", [LONG, f"Two {LONG}"]),
        (f"<body><form id=page><nav>n</nav><div><p>{LONG}<p>Two {LONG}<div class=alert-box>Three {LONG}</div><div class=share-bar>Share</div></div><input></form>", [LONG, f"Two {LONG}", f"Three {LONG}"]),
        (f"<body><div><section><p>{LONG}<p>Two {LONG}</section><section id=notices><p>{LONG}</section><div id=comments><p>{LONG}</div></div>", [LONG, f"Two {LONG}", LONG]),
        (f"<body><div><p>{LONG}<p>Two {LONG}<p>{LONG}</div><div id=comments><p>{LONG}</div>", [LONG, f"Two {LONG}", LONG]),
    ],
)
def test_names_are_evidence_only(page, want):
    assert html_text.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><main><p>Lead {LONG}<p>Lead <b>two</b> {LONG}<article><h1>Head</h1>{f'<p>{LONG}' * 8}</article></main>", [f"Lead {LONG}", f"Lead two {LONG}", "Head", *[LONG] * 8]),
        (f"<body><article><p>1 {LONG}<p>{LONG}</article><article><p>2 {LONG}{f'<p>{LONG}' * 8}</article><div class=ad>x</div><article><p>3 {LONG}<p>{LONG}</article><article><h3>Teaser</h3><p><a href=x>other</a></article>", [f"1 {LONG}", LONG, f"2 {LONG}", *[LONG] * 8, f"3 {LONG}", LONG]),
    ],
)
def test_dense_siblings_of_an_article(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_density_alone_finds_the_text(spark, sf):
    """Pages whose articles are called div give the same text, but for those whose article is hardly longer than its title."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        want = html_text.main_text(page)
        if len(want) > 200:
            assert html_text.main_text(page.replace("<article", "<div").replace("</article", "</div")) == want


def test_long_page():
    body = "".join(f"<p>Sentence {i} of a long page, with words enough.</p>" for i in range(20_000))
    want = "\n".join(f"Sentence {i} of a long page, with words enough." for i in range(20_000))
    assert html_text.main_text(f"<body><nav>{'<a href=x>y</a>' * 9}</nav><div>{body}</div>") == want


def test_pages(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op10_html_text"](spark, sf).collect():
        article = re.sub(r"</?(?:b|a|i)>|<br>", "", re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "t", 0), (None, "u", "<p>x", "t", 0), (1, None, None, "t", 0)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(r.text for r in html_text.extract_text(odd).collect()) == ["", "", "x"] and html_text.extract_text(odd.limit(0)).count() == 0


# the pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = texts_of(docs)
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    links = plain_links([(i, t) for i, t in sorted(rows.items()) if i in good])
    seen, kept = set(), set()
    for i in sorted(good):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += links[x]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(x in rows[i] for x in items)}
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == clean and len(out) == len(clean) < len(kept) < len(good) < len(rows)
    assert [len(s) for s in p.STAGES] == [2] * 4


@pytest.mark.parametrize(("rows", "want"), [(ODD, [1, 2, 4, 5, 7, 7, 8, None]), ([], [])])
def test_pipeline_of_odd_tables(spark, tmp_path, rows, want):
    import corpus_pipeline as p

    folder = str(tmp_path)
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, "t"), (None, 0, "t"), (4, None, "t")], "doc_id long, quality int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "short one", 0.5), (2, None, 0.5), (None, "", 0.5)], "item_id long, text string, score double").write.parquet(f"{folder}/benchmark.parquet")
    got = [r.doc_id for r in p.run(spark, folder).collect()]
    assert sorted(got, key=lambda i: (i is None, i)) == want


def test_long_message(spark):
    text = "many words in </s> one message " * 100_000
    row = chat.digests(chat.format_chats(spark.createDataFrame([(1, 0, 0, "message", "assistant", text)], "conv_id long, seq long, message long, kind string, role string, text string"))).first()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
