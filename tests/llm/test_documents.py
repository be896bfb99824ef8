"""Operators on documents against brute force, with nulls, copies, ties and clashing names."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loadlens.llm import licenses, mixing, packing, quality, simhash
from loadlens.session import snapshot

SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
    "fp BIGINT, size BIGINT, score DOUBLE, key INT, label INT, target DOUBLE"
)
WORDS = ["tree", "Stone", "river", "light,", "ünder", "cold", "MIT", "wall.", "7", "a"]


def texts():
    rng = np.random.default_rng(5)
    made = [" ".join(rng.choice(WORDS, n)) for n in rng.integers(1, 60, 60)]
    long = " ".join(rng.choice(WORDS, 9000))
    near = long.replace("cold", "warm", 1)
    return made + ["", None, " \t\n", "one", long, near, made[0], made[0], "x" * 50_000, None]


def documents(spark, rows=None):
    if rows is None:
        rows = [(i, t, ["a", "b", None, "é"][i % 4]) for i, t in enumerate(texts())]
        rows += [(3, texts()[3], "a"), (None, "no id", "a"), (None, "no id", "b")]
    data = [(i, t, "en", s, len(t or ""), 1, 2, 0.5, 3, 1, 9.0) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def rows_of(df, *order):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [str(r[c]) for c in order])


def roots(count, pairs):
    parent = list(range(count))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(count)]


# --- SimHash ------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    docs = documents(spark)
    got = [r.asDict() for r in simhash.near_duplicates(docs).collect()]
    text_of = {(i, plain_fingerprint(t)) for i, t in ((r.doc_id, r.text) for r in docs.collect())}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in got} == text_of
    prints = [int(r["fingerprint"], 16) for r in got]
    near = [
        (i, j) for i in range(len(prints)) for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    groups = roots(len(prints), near)
    for r, g in zip(got, groups):
        ids = [x["doc_id"] for x, h in zip(got, groups) if h == g and x["doc_id"] is not None]
        assert r["component_id"] == min(ids, default=None)


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for n in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[n] ^= np.uint64(1) << np.uint64(bit)
    keys = []
    for values in (a, b):
        own = {}
        for row, key in zip(*(x.tolist() for x in simhash.keys_of(values))):
            own.setdefault(row, set()).add(key)
        keys.append(own)
    assert all(keys[0][n] & keys[1][n] for n in range(len(a)))


def test_large_groups_are_cut_without_losing_links(spark, monkeypatch):
    from loadlens.llm import base

    values = [1 << n for n in range(60)] + [3 << n for n in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id BIGINT, fp BIGINT")
    monkeypatch.setattr(base.bucket_rows, "__defaults__", (8, None))
    got = simhash.with_components(snapshot(df, "test")).collect()
    assert {r.component_id for r in got} == {0}


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(map(str, ids)) == sorted(map(str, groups))


def test_long_chains_are_one_component(spark):
    from loadlens.llm.base import components

    links = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 501)], "a BIGINT, b BIGINT")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {n: 0 for n in range(201)} | {500: 500, 501: 500}


# --- mixing ---------------------------------------------------------------------


def test_mixing_matches_sql_and_targets(spark, tmp_path):
    docs = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    theirs = con.execute(mixing.TAKEN_SQL).fetchall()
    mine = [tuple(r) for r in mixing.taken(docs).collect()]
    assert sorted(map(str, mine)) == sorted(map(str, theirs))
    assert all(taken <= 3 * size for _, size, _, _, taken in mine)


def test_mix_has_the_planned_words_and_reruns_agree(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    planned = {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken}
    out = mixing.shuffled(mixing.mixed(docs))
    assert out.columns == docs.columns
    first = [tuple(r) for r in out.collect()]
    again = [tuple(r) for r in mixing.shuffled(mixing.mixed(docs)).collect()]
    assert sorted(map(str, first)) == sorted(map(str, again))
    words = {}
    for row in first:
        words[row[0]] = words.get(row[0], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", row[1]))
        assert row[4] == len(row[1])
    assert words == planned


def test_tree_gives_every_unit_one_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    blocks = spark.createDataFrame(
        [(s, b, 10, 1, 10 if b < 3 else 0) for s in ("a", None) for b in range(20)],
        "source STRING, _block BIGINT, _block_size BIGINT, _passes BIGINT, _drawn BIGINT",
    )
    got = mixing.quotas(blocks).collect()
    assert len(got) == 46 and len({(r.source, r._block, r._pass) for r in got}) == 46
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_leaves_add_up_to_what_is_planned_of_each_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 4)
    blocks = spark.createDataFrame(
        [(s, b, 10, b, 2 if s else 0, [10, 4, 0][b % 3]) for s in ("a", None) for b in range(9)],
        "source STRING, _block BIGINT, _block_size BIGINT, _place INT, _passes BIGINT, _drawn BIGINT",
    )
    got = mixing.drawn_units(blocks).select(*blocks.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, blocks.collect()))


# --- packing ----------------------------------------------------------------------


def test_packing_round_trip(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["a.. b, c.\nD!", "İstanbul ΣΑΣ", "e\u0301 K", "<|endoftext|> x", "don't 12.5%", "日本語 x\x1cy", "\u03a1\u0313 x"]
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts() + odd)] + [(None, "q", "a")])
    parts = snapshot(packing.pieces(docs, path), "test")
    got = packing.pack(parts, group=20).collect()
    tokenizer = Tokenizer.from_file(path)
    wanted = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            wanted.append((r.doc_id, n, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(str, (tuple(r[:5]) for r in got))) == sorted(map(str, wanted))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(w[3] for w in wanted) // 2048) + 1


def test_best_fit_prefers_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]


# --- licenses ---------------------------------------------------------------------


def test_licenses_base_and_fuzzy(spark):
    cases = {
        0: "Released under the MIT License. mit-license", 1: "released undr the mit licence",
        2: "GNU General Public License", 3: "licensed under cc by nc 4.0", 4: "nothing here",
        5: None, 6: "", 7: "smit license", 8: "word " * 30_000 + "Apache License",
    }
    got = {r.doc_id: r for r in licenses.scan(documents(spark, [(i, t, "a") for i, t in cases.items()])).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 3, 5, "mit")
    assert (got[1].n_base, got[1].labels, got[1].first_word) == (0, "mit", None)
    assert 0 < got[1].score < 1 and got[1].spans[0].edits == 2
    assert got[2].base_labels == "gpl" and got[3].labels == "cc-by-nc"
    assert [got[n].labels for n in (4, 5, 6)] == ["", "", ""] and got[5].n_words == 0
    assert got[7].n_base == 0
    assert (got[8].n_words, got[8].first_word, got[8].base_labels) == (30_002, 30_000, "apache")


def test_a_better_notice_hides_none_before_it():
    one, two = "under the gnu genral public license", "under the gnu general public license"
    spans = licenses.Scanner().scan(f"{one} {two}")["spans"]
    assert [(s["text"].strip(), s["edits"]) for s in spans if s["label"] == "gpl"] == [(one, 1), (two, 0)]


def test_pigeonhole_seeds_find_what_a_full_search_finds():
    scanner = licenses.Scanner()
    rng = np.random.default_rng(2)
    letters = "abcdefghij "
    for notice, pattern in zip(scanner.notices, scanner.patterns):
        for _ in range(20):
            changed = list(notice.text)
            for at in rng.integers(0, len(changed), notice.edits + 1):
                changed[at] = letters[rng.integers(len(letters))]
            line = "some words before " + "".join(changed) + " and after"
            found = {s[0] for s in scanner.fuzzy(line)}
            assert (notice.label in found) >= bool(pattern.search(line))


# --- quality ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = rng.choice(["calm", "sea", "wind", "hill", "the", "of"], rng.integers(5, 80))
        rows.append((i, " ".join(words) if good else "!! ".join(w.upper() for w in words), "a"))
        labels.append((i, int(good), "x"))
    rows += [(400, None, "a"), (401, "", "b"), (None, "calm sea", "a"), (1, rows[1][1], "a")]
    labels += [(None, 1, "x"), (5, None, "x"), (7, 5, "x"), (999, 1, "x"), (1, 1, "x")]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, text STRING")


def test_quality_separates_held_out_rows(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_held_out_labels_do_not_matter(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = rows_of(quality.classify(docs, labels), "doc_id", "score")
    assert a == rows_of(quality.classify(docs, flipped), "doc_id", "score")


def test_quality_without_both_classes(spark, labelled):
    docs, labels = labelled
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rows = [np.array([0, 1]), np.array([1, 2]), np.array([0, 2])]
    values = [np.array([1.0, 1.0]), np.array([1.0, 0.5]), np.array([-1.0, 0.2])]
    signs, costs = np.array([1.0, -1.0, -1.0]), np.full(3, 0.7)
    w = quality.dual_coordinate_descent(rows, values, signs, costs, 3, epochs=500, tolerance=1e-9)

    def loss(w):
        return w @ w / 2 + sum(
            c * max(0, 1 - s * (w[r] @ v)) for r, v, s, c in zip(rows, values, signs, costs)
        )

    rng = np.random.default_rng(1)
    assert all(loss(w) <= loss(w + d) + 1e-6 for d in rng.normal(0, 0.05, (500, 3)))


# --- all of them ----------------------------------------------------------------------


def test_empty_tables(spark, labelled):
    none = documents(spark, [])
    path = public_tokenizers.path("word_bpe_49k.json")
    assert simhash.near_duplicates(none).count() == 0
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0
    assert packing.pack_documents(none, path).count() == 0
    assert licenses.scan(none).count() == 0
    assert quality.classify(none, labelled[1]).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path, labelled):
    docs, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = snapshot(stage(spark, given, str(tmp_path)), "stage")
        assert given.columns == docs.columns, name
    kept = {r.doc_id for r in given.collect()}
    assert all(i % 3 for i in kept if i is not None and i < 400)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept


# --- repeated ids, clashing names, hostile cases --------------------------------------


@pytest.mark.parametrize("text", [
    "released under the bsd license", "released under the isc license",
    "released under the gpl license", "released under the old license",
    "licensed under cc by sa", "licensed under cc by nd", "licensed under cc by 4.0",
    "gnu lesser general public license here", "creative commons share alike license",
    "subject to the terms of the eclipse public license", "licensed under the artistic license version",
    "under the new general purpose license", "released under the bit license",
])
def test_other_licenses_are_not_taken_for_a_known_one(text):
    found = {label for label, *_ in licenses.Scanner().fuzzy(licenses._GAPS.sub(" ", text))}
    assert found <= ({"lgpl"} if "lesser" in text else set())


def test_every_notice_is_told_from_every_other():
    scanner = licenses.Scanner()
    for notice in licenses.NOTICES:
        for wrong in (notice.text, notice.text.replace("license", "licence"), notice.text.replace("e ", " ", 1)):
            assert {label for label, *_ in scanner.fuzzy(wrong)} == {notice.label}


def test_base_places_match_brute_force(spark):
    rng = np.random.default_rng(12)
    words = ["mit", "license", "apache", "general", "public", "MIT", "License", "licenses", "x", "xmit"]
    gaps = [" ", "  ", "-", "\n", ".", " (", "\u00a0"]
    rows = [(i, "".join(words[rng.integers(10)] + gaps[rng.integers(7)] for _ in range(rng.integers(60))))
            for i in range(300)]
    phrases = [(p.split(" "), label) for p, label in licenses.PHRASES.items()]
    for r in licenses.scan(documents(spark, [(i, t, "a") for i, t in rows])).collect():
        own = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(dict(rows)[r.doc_id]))
        at = [(i, label) for p, label in phrases for i in range(len(own)) if own[i:i + len(p)] == p]
        places = sorted(i for i, _ in at)
        assert (r.n_words, r.n_base) == (len(own), len(at))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


CLASHING = ("_quality", "_fp", "_row", "_take", "shard", "_block", "root", "length", "_n", "score")


def clashing(spark, rows):
    """Rows (doc_id, text) with columns named like those used on the way."""
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, " + ", ".join(
        f"`{c}` STRING" for c in CLASHING)
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) + tuple(f"{c}{i}" for c in CLASHING) for i, t in rows], schema)


NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
OTHER = "completely different words stand here and nothing of it is like the rest at all"


def test_one_of_each_group_stays_where_ids_repeat(spark):
    df = clashing(spark, [(1, NEAR), (3, NEAR), (3, OTHER), (None, OTHER), (None, "alone " * 9)])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "alone " * 9), (1, NEAR), (3, OTHER)]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_stages_take_columns_of_any_name(spark):
    rows = [(i, f"{NEAR} {i} " + " ".join(f"w{(i * 7 + n * n) % 50}" for n in range(60))) for i in range(40)]
    df = clashing(spark, rows)
    drawn = mixing.shuffled(mixing.mixed(df))
    assert drawn.columns == df.columns
    for r in drawn.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHING)
    assert simhash.keep_one(df).schema == df.schema


def test_equal_pieces_are_dealt_to_all_groups(spark, monkeypatch):
    parts = spark.createDataFrame(
        [(None, 0, 0, 10, 7)] * 4000, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")
    packed = packing.pack(snapshot(parts, "pieces"), capacity=100, group=200)
    sizes = [r["n"] for r in packed.groupBy("sequence_id").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) == 10 and len(sizes) <= 400 + 20
    groups = packed.select((F.shiftright("sequence_id", 24) % (1 << 30)).alias("g")).distinct().count()
    assert groups > 10


def test_the_pipeline_takes_empty_tables_and_clashing_names(spark, tmp_path):
    empty = tmp_path / "empty"
    clashing(spark, []).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(
        str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    rows = [(i, f"{NEAR} {i} " + " ".join(f"w{(i * 7 + n * n) % 50}" for n in range(60))) for i in range(40)]
    clashing(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(
        str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_very_long_texts_are_scored_and_scanned_whole(spark):
    long = " ".join(f"word{n % 977}" for n in range(200_000))
    rows = [(i, long if i == 1 else f"short {i} text", "a") for i in range(12)]
    df = documents(spark, [*rows, (12, long + " mit license", "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id BIGINT, quality INT")
    scored = {r.doc_id: r.score for r in quality.classify(df, labels).collect()}
    assert len(scored) == 13 and all(0 <= s <= 1 for s in scored.values())
    scanned = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (scanned[12].n_words, scanned[12].first_word, scanned[12].labels) == (200_002, 200_000, "mit")
