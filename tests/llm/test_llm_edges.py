"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import TESTDATA
from lexmesh.llm import decontaminate, html_text, jaccard_join, language, line_dedup, nearest, pieces, secrets, substring_dedup, warc
from lexmesh.llm.queries import SENTENCEPIECE_MODEL
from lexmesh.session import scratch_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "_id", "_row", "c0", "key", "cid", "blob", "path", "groups", "cuts", "digest", "doc", "text_lang", "component_id", "first", "label", "host"]


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    for name in CLASHING:  # columns that the operators use themselves
        df = df.withColumn(name, F.lit("clash"))
    return df


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


LONG = " ".join(f"w{i}" for i in range(400_000))  # above the slice of the word hashes
ODD = [(1, None), (2, ""), (3, "x"), (None, "a line without an id"), (4, "a line without an id"), (5, "twin line of five\nshort"), (5, "other text of five"),
       (6, "twin line of five\nshort"), (6, "twin line of five\nshort"), (7, LONG)]


def test_line_dedup(spark):
    found = by_id(line_dedup.drop_repeated_lines(documents(spark, ODD), carry=["row", "c0", "lang"]))
    assert sum(map(len, found.values())) == len(ODD)
    one = {i: [(r.n_lines, r.n_dropped, r.text) for r in rows] for i, rows in found.items()}
    assert one[1] == one[2] == [(1, 0, "")]
    assert one[4] == [(1, 0, "a line without an id")] and one[None] == [(1, 1, "")]  # a row without an id is larger than all others
    assert sorted(one[5]) == [(1, 0, "other text of five"), (2, 0, "twin line of five\nshort")]
    assert one[6] == [(2, 1, "short")] * 2 and one[7] == [(1, 0, LONG)]
    assert found[1][0].row == found[1][0].c0 == "clash" and found[1][0].lang == "en"
    assert all(r.kept_sha256 == sha(r.text) for rows in found.values() for r in rows)


def test_line_keys(spark):
    rows = [(2, "\x0b Straße ÄÖ 1\t"), (1, "sTRAßE ÄÖ 1"), (3, "straße äö 1"), (4, " Straße ÄÖ 1")]
    dropped = {i: r[0].n_dropped for i, r in by_id(line_dedup.drop_repeated_lines(documents(spark, rows))).items()}
    assert dropped == {1: 0, 2: 1, 3: 0, 4: 0}  # only A-Z are folded, only six characters are stripped


def test_secrets(spark):
    key = "AKIA" + "A" * 16
    rows = [(1, None), (1, ""), (2, f"é password = 'abc' token:token:abcdef {key} {'0a' * 12}"), (None, "api-key: x apikey:abcdef"), (3, f"token={'0a' * 12}"), (4, "secret=x\n" * 3000 + "secret=abcdef")]
    found = by_id(secrets.find_secrets(documents(spark, rows)))
    assert [r.spans for r in found[1]] == ["", ""] and found[1][0].base_sha256 == sha("")
    assert found[2][0].spans == "access:38:58,hex:59:83"  # short values use up their text and are dropped
    assert found[None][0].spans == "assign:11:24" and found[3][0].spans == "assign:0:30,hex:6:30"
    assert found[4][0].spans == "assign:27000:27013" and found[4][0].n_assign == 1


def test_ledger_scans_a_blob_once(spark):
    folder = scratch_folder(spark, "ledger")
    first = spark.createDataFrame([("a", "token=abcdef"), ("b", "nothing")], "path string, text string")
    second = spark.createDataFrame([("a2", "token=abcdef"), ("b", "token=ghijkl"), ("c", None)], "path string, text string")
    assert {r.path: r.spans for r in secrets.scan_versions(first, folder).collect()} == {"a": "assign:0:12", "b": ""}
    assert {r.path: r.spans for r in secrets.scan_versions(second, folder).collect()} == {"a2": "assign:0:12", "b": "assign:0:12", "c": ""}
    ledger = spark.read.parquet(f"{folder}/rules={secrets.RULES}")
    assert ledger.count() == ledger.select("blob").distinct().count() == 4
    assert secrets.scan_versions(second, folder, "2").count() == 3
    assert spark.read.parquet(f"{folder}/rules=2").count() == 3


def test_ledger_that_holds_a_blob_twice(spark):
    folder = scratch_folder(spark, "ledger")
    versions = spark.createDataFrame([("a", "token=abcdef"), ("b", "token=abcdef"), ("b", "token=abcdef"), ("c", "nothing")], "path string, text string")
    secrets.scan_versions(versions, folder)
    place = f"{folder}/rules={secrets.RULES}"
    held = spark.createDataFrame(spark.read.schema(secrets.LEDGER).parquet(place).collect(), secrets.LEDGER)
    held.write.mode("append").parquet(place)  # what a second scanner appends that started before the first had
    found = sorted((r.path, r.n_assign, r.spans) for r in secrets.scan_versions(versions, folder).collect())
    assert found == [("a", 1, "assign:0:12"), ("b", 1, "assign:0:12"), ("b", 1, "assign:0:12"), ("c", 0, "")]
    assert spark.read.parquet(place).count() == 4


def windows(rows, size=20):
    """Brute force; rows without an id come last, rows that share an id are not earlier than each other."""
    order = lambda i: float("inf") if i is None else i
    texts = [(order(i), (t or "").split()) for i, t in rows]
    first: dict[tuple, float] = {}
    for i, w in texts:
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone, seen = [False] * len(w), set()
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            if first[k] < i or k in seen:
                gone[s:s + size] = [True] * size
            seen.add(k)
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def test_substring_dedup(spark):
    random.seed(5)
    words = [f"v{i}" for i in range(300)]
    passage = [random.choice(words) for _ in range(60)]
    rows = [(i, " ".join([random.choice(words) for _ in range(random.randint(0, 40))] + passage[random.randint(0, 20):random.randint(30, 60)] + ["z"] * random.randint(0, 50)))
            for i in range(60)]
    rows += [(60, " ".join(passage)), (60, " ".join(passage + ["q"])), (None, " ".join(passage)), (None, " ".join(passage)), (61, None), (62, ""), (63, LONG), (64, LONG), (65, "y " * 19), (66, " ".join(passage))]
    found = substring_dedup.remove_repeated_windows(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(
        (i is None, i or 0, *w) for (i, _), w in zip(rows, windows([(i, t.replace(" ", "_") if t else t) for i, t in rows[:-1]] + [rows[-1][:1] + ("x",)])[:-1] + [(1, 0, sha(" ".join(passage)))]))
    assert all(sha(r.text) == r.kept_sha256 for r in found)


def test_archives(spark):
    rows = [(1, "http://a", "same"), (3, "http://b\nc", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (None, None, "same"), (None, "n", "alone"), (3, "http://b2", "same"), (9, "z", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("refers_to", F.lit(3))
    folders = [scratch_folder(spark, "warc") for _ in range(2)]
    manifests = [sorted(warc.write_archives(pages.repartition(n), f, file_bytes=300).drop("temporary").collect()) for n, f in zip((1, 3), folders)]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3  # same bytes whatever the partitions; rolled by size
    for folder in folders:
        found = warc.read_archives(spark, folder, with_html=True).collect()
        assert len(found) == len(rows)
        kinds = sorted((r.page_id is None, r.page_id or 0, r.url or "", r.record_type, r.refers_to or 0) for r in found)
        assert kinds == [(False, 1, "http://a", "revisit", 3), (False, 2, "", "revisit", 4), (False, 3, "http://b%0Ac", "response", 0), (False, 3, "http://b2", "response", 0), (False, 4, "u", "response", 0),
                         (False, 5, "u", "response", 0), (False, 9, "z", "response", 0), (True, 0, "", "revisit", 3), (True, 0, "n", "response", 0)]
        for r in found:
            if r.page_id == 5:
                assert r.html == "é" * 100_000 and r.payload_bytes == 200_000
                assert r.payload_digest == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()


def test_archives_of_ids_at_both_ends_and_far_apart(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(i, f"u{i}", f"page {i} " * 5) for i in range(1500)] + [(None, f"n{i}", f"no id {i} " * 5) for i in range(700)] + [(low, "l", "same"), (high, "h", "same"), (high - 1, "g", None)]
    rows += [(77, f"r{i}", f"hot id {i} " * 5) for i in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("spread", F.lit("clash")).withColumn("size", F.lit("clash"))
    folder = scratch_folder(spark, "warc")
    files = warc.write_archives(pages.repartition(5), folder).collect()
    assert sum(f.records for f in files) == len(rows) and max(f.records for f in files) <= len(rows) / 20
    found = warc.read_archives(spark, folder, with_html=True).collect()
    assert sorted((r.page_id or 0, r.url) for r in found) == sorted((i or 0, u) for i, u, _ in rows)
    told = {r.page_id: (r.record_type, r.refers_to) for r in found}
    assert told[low] == ("revisit", high) and told[high] == ("response", None) and told[high - 1] == ("response", None)
    assert all(r.record_type == "response" for r in found if r.page_id != low)


def test_lost_attempts_are_not_read(spark):
    folder = scratch_folder(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.write_archives(pages, folder)
    files, root = warc._open(folder)
    with files.open_output_stream(f"{root}/_temporary/lost-000001-00000", compression=None) as stream:
        stream.write(b"half a rec")
    assert warc.read_archives(spark, folder).count() == 1


def test_jaccard(spark):
    base = [f"b{i}" for i in range(60)]
    near = [*base[:30], "changed", *base[31:]]
    rows = [(9, " ".join(base)), (4, " ".join(base).upper()), (7, " ".join(near)), (8, " ".join(near[:28])), (1, None), (2, ""), (3, "one two"), (5, "ONE  two"), (6, "one"), (None, " ".join(base)), (None, "alone here"),
            (7, "another text under the same id as before"), (10, LONG), (11, LONG)]
    found = by_id(jaccard_join.jaccard_components(documents(spark, rows)))
    labels = {i: sorted((r.n_shingles, r.component_id) for r in v) for i, v in found.items() if i is not None}
    assert labels == {9: [(56, 4)], 4: [(56, 4)], 7: [(4, 7), (56, 4)], 8: [(24, 8)], 1: [(0, 1)], 2: [(0, 2)], 3: [(1, 3)], 5: [(1, 3)], 6: [(1, 6)], 10: [(399_996, 10)], 11: [(399_996, 10)]}
    assert sorted((r.n_shingles, r.component_id or 0) for r in found[None]) == [(1, 0), (56, 4)]


def test_lists_of_the_same_classes_are_kept_once(spark):
    lists = {(1, False): "abc", (2, False): "abc", (3, False): "ab", (4, True): "abc", (5, False): "d", (6, True): "abc", (7, False): "abd"}
    room = {1: 3, 2: 5, 3: 4, 4: 6, 5: 9, 6: 2, 7: 1}
    keys = spark.createDataFrame([(k, s, bytearray(c.encode()), 9, room[k]) for (k, s), members in lists.items() for c in members], "key long, subset boolean, cid binary, n int, room int")
    assert {(r.key, r.subset) for r in jaccard_join._different_lists(keys).collect()} == {(2, False), (3, False), (4, True), (7, False)}


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_rows_that_a_join_does_not_need_stay_behind(spark, kind):
    key = F.xxhash64("id") if kind == "long" else F.unhex(F.md5(F.col("id").cast("string")))
    table = spark.range(20000).select(key.alias("k"), "id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("other"))
    kept = jaccard_join._among(table, table.filter("id % 100 = 0").select("k"))
    assert kept.schema == table.schema
    rows = {(r.id, r.other) for r in kept.collect()}
    assert rows >= {(i, i if i % 7 else None) for i in range(0, 20000, 100)} and len(rows) < 1000


def test_whole_sets_hold_what_other_sets_may_hold():
    text = " ".join(f"w{i}" for i in range(40))
    every = next(jaccard_join.shingle_sets(pa.array([text]), 5))[1]
    run = jaccard_join._whole_sets(5, lambda keys: np.ones(len(keys), bool), lambda found: found >= every[30])
    row = pa.Table.from_batches(run(iter([pa.RecordBatch.from_pydict({"text": [text]})]))).to_pylist()[0]
    assert row["size"] == len(every) == 36 and np.frombuffer(row["shingles"], np.uint64).tolist() == every[30:].tolist()


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_equals_brute_force(spark, seed):
    random.seed(seed)
    rows, groups = [], [[f"g{g}x{i}" for i in range(random.choice((4, 6, 8, 12, 40, 90)))] for g in range(25)]
    for i in range(250):
        words = [w if random.random() > 0.04 else f"r{random.randrange(50)}" for w in random.choice(groups)]
        rows.append((i, " ".join(words[random.randint(0, 1):] + ["common phrase that very many texts have at their end"] * random.randint(0, 1))))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
    label = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()} == {i: (len(sets[i]), label[i]) for i in sets}


def test_masks_lose_nothing():
    assert decontaminate.lossless(decontaminate.MASKS, decontaminate.WINDOW, decontaminate.ERRORS)


def test_decontamination(spark):
    item = [f"t{i}" for i in range(30)]
    short = [f"s{i}" for i in range(9)]
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(short)), (3, "too short an item"), (4, None), (None, ""), (5, " ".join(f"q{i}" for i in range(15)))], "item_id long, text string").withColumn("key", F.lit("k"))
    wrong = lambda at: " ".join("no" if i in at else w.upper() for i, w in enumerate(item))
    rows = [(1, None), (2, ""), (3, wrong([])), (4, "x " + wrong([3, 9, 17, 23])), (5, wrong(range(0, 30, 5))), (6, "too short an item"), (7, "y " + " ".join(short)), (8, " ".join(short[:8])), (None, wrong([0])),
            (9, LONG + " " + wrong([])), (10, "clean"), (10, wrong([29]))]
    found = sorted((r.doc_id or 0, r.item_id, r.first_word, r.n_words) for r in decontaminate.contaminated(documents(spark, rows), items).collect())
    assert found == [(0, 1, 0, 30), (3, 1, 0, 30), (4, 1, 1, 30), (7, 2, 1, 9), (9, 1, 400_000, 30), (10, 1, 0, 30)]
    kept = decontaminate.without_contaminated(documents(spark, rows), items)
    assert kept.columns == documents(spark, rows).columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, ""), (2, ""), (5, rows[4][1]), (6, rows[5][1]), (8, rows[7][1]), (10, "clean")])


def test_languages_of_odd_rows(spark):
    train = [(i, f"the house of the man and the water {i} was there", "EN-us", "e") for i in range(30)] + [(100 + i, f"das haus und der mann mit dem wasser {i} ist hier", "de", "d") for i in range(30)]
    odd = [(200, None, "en", None), (201, "", None, "e"), (202, "12 %% ..", "en", "e"), (203, "der mann und das haus " * 100_000, None, None), (None, "the water of the house", "zz!", "e"), (204, "the man", "de", "e"), (205, "the man", "de", "e")]
    docs = spark.createDataFrame([(i, t, lang, source) for i, t, lang, source in train + odd], "doc_id long, text string, lang string, source string")
    for name in ("markup", "address", "host", "declared", "scores", "n", "best"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = by_id(language.identify(language.document_records(docs), ["doc_id", "row"]))
    told = {i: (r[0].lang, r[0].keep) for i, r in found.items()}
    assert all(told[i] == ("en" if i < 100 else "de", True) for i, *_ in train)
    assert told[200] == told[201] == told[202] == ("und", False) and told[203] == ("de", True) and told[None] == ("en", True)
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(train) + len(odd) - 3


def test_rare_languages_and_copies(spark):
    rows = [(i, f"the house of the man and the water {i} was there", "en") for i in range(600)] + [(1000 + i, "one text that very many rows hold", "en") for i in range(600)]
    rows += [(2000 + i, f"maja ja mees ning vesi {i} on siin kuskil", "et") for i in range(25)] + [(3000 + i, f"den mann an d'haus mat waasser {i}", "lb") for i in range(3)]
    rows += [(4000, "mees ja maja on kuskil", None), (4001, "12 %%", "lb"), (4002, "mann an d'haus", None), (4003, "the man was there", "und")]
    docs = spark.createDataFrame([(i, t, lang, None) for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    records = language.document_records(docs)
    found = {r.doc_id: (r.lang, r.keep) for r in language.identify(records, ["doc_id"], train_rows=100).collect()}
    assert all(found[i] == (lang, True) for i, _, lang in rows if i < 4000)  # et: 2 % of the rows, lb: without a text model
    assert found[4000] == ("et", True) and found[4001] == ("und", False) and found[4002][0] != "lb" and found[4003] == ("en", True)
    names, drawn = language.training_texts(records.select(F.col("markup").alias("declared"), "text").filter("declared != 'und'"), 100)
    held = [tuple(r) for r in drawn.collect()]
    assert names == ["en", "et"] and len(set(held)) == len(held) and sum(lang == "et" for lang, _ in held) == 25
    assert 60 < sum(lang == "en" for lang, _ in held) < 140


def test_pages_use_markup_and_address(spark):
    pages = [(i, f"https://www.site{i % 3}.de/x", f"<html lang='de-DE'><body><p>das haus und der mann mit dem wasser {i}</body>") for i in range(30)]
    pages += [(100 + i, f"http://news{i % 3}.co/x", f'<html lang="en"><p>the house of the man and the water {i}') for i in range(30)]
    pages += [(200, "https://www.site1.de/y", "<html lang=de><p>abc"), (201, "http://news1.co/z", "<p>abc"), (202, None, None)]
    found = {r.page_id: r.lang for r in language.identify(language.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")), ["page_id"]).collect()}
    assert all(found[i] == "de" and found[100 + i] == "en" for i in range(30))
    assert (found[200], found[201], found[202]) == ("de", "en", "und")


def fused_by_hand(rows, text_scores, languages, drop=None):
    """Plain Python over (declared, suffix, domain, host) rows and their scaled text scores; ``drop`` leaves one kind of evidence out."""
    prior = [math.log(language.UNKNOWN_SHARE if n == "und" else 1.0) for n in languages]
    k, size = language.SMOOTHING, len(languages)
    best = [max(range(size), key=lambda i: s[i] + prior[i]) for s in text_scores]
    count = lambda keep: [float(sum(b == i and keep(r) for b, r in zip(best, rows))) for i in range(size)]
    smooth = lambda n, towards: [(x + k * p) / (sum(n) + k) for x, p in zip(n, towards)]
    whole = count(lambda r: True)
    everywhere = [(n + 1.0) / (sum(whole) + size) for n in whole]
    values = {r[0] for r in rows} - {None}
    declaring = count(lambda r: r[0] is not None)
    out = []
    for (declared, suffix, domain, host), scores, own in zip(rows, text_scores, best):
        towards = everywhere
        if suffix and drop != "suffix":
            towards = smooth(count(lambda r: r[1] == suffix), towards)
        if domain and drop != "domain":
            towards = smooth(count(lambda r: r[2] == domain), towards)
        host_prior = towards
        if host and drop != "host":
            n = count(lambda r: r[3] == host)
            host_prior = smooth([x - (i == own and drop != "own") for i, x in enumerate(n)], towards)
        said = [math.log((x + 1.0 / len(values)) / (all_ + 1.0)) for x, all_ in zip(count(lambda r: r[0] == declared), declaring)] if declared and drop != "declared" else [0.0] * size
        fused = [(0.0 if drop == "text" else s) + math.log(h) + d + (0.0 if drop == "unknown" else p) for s, h, d, p in zip(scores, host_prior, said, prior)]
        out.append((max(range(size), key=lambda i: fused[i]), 1.0 / sum(math.exp(f - max(fused)) for f in fused)))
    return out


def test_every_kind_of_evidence_counts(spark):
    english, german, short = "the house of the man and the water was there", "das haus und der mann mit dem wasser ist hier", ("the haus", "der house", "in the", "in der", "man", "ist was")
    rows = [(f"http://{'abc'[i % 3]}.{'mn'[i % 2]}.{('de', 'uk')[i % 7 == 0]}/{i}", ("de", "en")[i % 5 == 0] if i % 4 else None, f"{german if i % 7 else english} {i}") for i in range(60)]
    rows += [(f"http://{'xyz'[i % 3]}.{'pq'[i % 2]}.{('uk', 'de')[i % 9 == 0]}/{i}", ("en", "de")[i % 6 == 0] if i % 4 else None, f"{english} {i}") for i in range(60)]
    rows += [(f"http://{'abxy'[i % 4]}.{'mp'[i % 4 // 2]}.{('de', 'uk')[i % 4 // 2]}/s{i}", (None, "en", "de")[i % 3], short[i % 6]) for i in range(36)] + [(None, None, "in der the"), ("http://lone.org", None, "man")]
    records = spark.createDataFrame([(i, text, tag, url, None) for i, (url, tag, text) in enumerate(rows)], "id long, text string, markup string, address string, host string")
    model = language.fit(records.select("text", F.col("markup").alias("declared")))
    scores = (model.score(pa.array([r[2] for r in rows]))[0] * language.TEXT_WEIGHT).tolist()
    parts = [(tag, *((None,) * 3 if url is None else (host.split(".")[-1], ".".join(host.split(".")[-2:]), host))) for url, tag, _ in rows for host in [url and url.split("/")[2]]]
    found = sorted((r.id, model.languages.index(r.lang), r.posterior) for r in language.identify(records, ["id"]).collect())
    wanted = fused_by_hand(parts, scores, model.languages)
    assert [lang for _, lang, _ in found] == [lang for lang, _ in wanted]
    assert np.allclose([p for *_, p in found], [p for _, p in wanted], rtol=1e-9)
    for kind in ("text", "declared", "suffix", "domain", "host", "own", "unknown"):  # each term moves what comes out
        assert not np.allclose([p for *_, p in found], [p for _, p in fused_by_hand(parts, scores, model.languages, kind)], rtol=1e-6), kind
    assert [x for x, _ in fused_by_hand(parts, scores, model.languages, "declared")] != [x for x, _ in wanted]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # many copies of one vector: ties
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [1.0]), (None, rows[5][1]), (500, []), (520, [-0.0, 1.0] + [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit("x")).withColumn("tree", F.lit(1))
    queries = vectors.filter("vec_id % 20 = 0")
    usable = {i: np.array(v) for i, v in rows if i is not None and i < 400 or i == 520}
    found: dict[int, list] = {}
    for r in nearest.nearest(vectors, queries).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == {i for i in usable if i % 20 == 0}
    for q, own in found.items():  # as many leaves as there are rows: the search is exact here
        best = sorted((-float(np.einsum("i,i->", v, usable[q])), i) for i, v in usable.items() if i != q)[:20]
        assert [i for _, i, _ in sorted(own)] == [i for _, i in best]
    few = vectors.filter("vec_id in (0, 1, 2)")
    assert sorted((r.query_id, r.rank) for r in nearest.nearest(few, few.filter("vec_id = 0")).collect()) == [(0, 1), (0, 2)]


def test_nearest_of_repeated_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] * 2 + [(50, [2.0, 1.0])] * 30 + [(60 + i, [2.0, 1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in nearest.nearest(vectors.repartition(3), vectors.filter("vec_id in (0, 50)")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [i for _, i in sorted(found[0])] == list(range(1, 21)) and [i for _, i in sorted(found[50])] == list(range(60, 80))


def test_extraction(spark):
    menu = "<nav><a href=x>Home</a> <a>About us</a></nav><div class='ad-box'>Buy now</div>"
    foot = "<p>All rights reserved by the owner of this site since long ago</p>"
    rows = [(1, "http://h/1", f"<html>{menu}<article><h1>One &amp; two</h1><p>A<b>b</b>c\n d<p>e<script>x='</p>'</script><div class=comments>no</div></article>{foot}"), (2, "http://h/2", None), (3, None, ""),
            (4, "http://h/4", f"<body>{menu}<p>Only here you read this text about cats</p>{foot}"), (5, "http://h/5", f"<body>{menu}<p>And here a text about dogs</p>{foot}"), (6, "http://other/6", f"<p>x</p>{foot}"),
            (None, "http://h/7", "<main>&lt;p&gt; &eacute;<br>f</main><footer>g"), (8, "http://h/8", "<article>" + "<p>long text</p>" * 50_000), (1, "http://h/1", "<article>again"), (9, "http://h/9", "<p>a < b <a href='")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("page", F.lit(1)).withColumn("host", F.lit(1))
    found = {(r.page_id, r.text): r.n_chars for r in html_text.extract_text(pages).collect()}
    owner = "All rights reserved by the owner of this site since long ago"
    wanted = [(1, "One & two\nAbc d\ne"), (2, ""), (3, ""), (4, "Only here you read this text about cats"), (5, "And here a text about dogs"), (6, f"x\n{owner}"), (None, "<p> é f"), (8, "\n".join(["long text"] * 50_000)), (1, "again"), (9, "a < b")]
    assert found == {k: len(k[1]) for k in wanted}


def test_boilerplate_of_a_host(spark):
    own = lambda i, n=30: " ".join(f"w{i}x{k}" for k in range(n))
    plea = "<p>Please subscribe to our weekly letter and never miss a story"
    phrase = "this is one of the most common phrases that people use"
    rows = [(i, "http://marked/", f"<article><p>{own(i)}{plea}</article>") for i in range(10)] + [(10 + i, "http://marked/", f"<article><p>{own(99)}<p>{own(98)}</article>") for i in range(4)]
    rows += [(20 + i, "http://copies/", f"<p>{own(20)}<p>{own(21)}") for i in range(2)] + [(30 + i, "http://open/", f"<p>{own(i)} {phrase if i < 4 else ''} {own(i + 50)}{plea}") for i in range(40)]
    rows += [(80 + i, "http://near/", f"<article><h1>Copy {i}</h1><p>{own(80)}</article>") for i in range(5)] + [(90 + i, "http://two/", f"<article><p>{own(90 + i)}{plea}</article>") for i in range(2)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(found[i].startswith(f"{own(i)}\nPlease") for i in range(10)) and all(found[10 + i] == f"{own(99)}\n{own(98)}" for i in range(4))
    assert all(found[20 + i] == f"{own(20)}\n{own(21)}" for i in range(2))
    assert all(found[30 + i] == " ".join(f"{own(i)} {phrase if i < 4 else ''} {own(i + 50)}".split()) for i in range(40))
    assert all(found[80 + i] == f"Copy {i}\n{own(80)}" for i in range(5)) and found[90].startswith(own(90)) and "letter" in found[90]


@pytest.mark.parametrize("page, text", [
    ("<article><p>a <svg width='5'/> b</p><p>c</article>", "a b\nc"),
    ("<article><p>a <svg><path class=share d='x'/><p>b</p></article>", "a\nb"),
    ("<article><p>a <svg><title>t</title><text>no</text></svg> b</p>c</article>", "a b\nc"),
    ("<article><p>x <math><mi>y</mi><mo>=</mo><mspace/><mn>2</mn></math> z<math/></p><p>q</article>", "x y=2 z\nq"),
    ("<article><div><select><option>no</div><p>b</article>", "b"),
    ("<article><select><option>no<p>b</article>", "b"),
    ("<article><div><video src=x>no</div><p>b<canvas>no</p><p>c</article>", "b\nc"),
    ("<article><object data=x><param name=a><p>kept</p></object><p>c</article>", "kept\nc"),
    ("<article><div><object data=x></div><p>b</article>", "b"),
    ("<article><p>a<template><p>no</p></template>b<noscript><div>no</div></noscript>c</article>", "abc"),
    ("<article><p>a<script>'<p>'</script>b<style>p{}</style><textarea><p>no</textarea>c</article>", "abc"),
])
def test_elements_without_text_end_with_their_parent(page, text):
    assert "\n".join(t for t, article, chrome in html_text.blocks(page) if article and not chrome) == text


@pytest.mark.parametrize("element, kept", [
    ('div class="menu-history"', True), ('p class="promotion"', True), ('p id="ad-hoc"', True), ("label", True), ('section id="social-history-of-france"', True),
    ('div class="notice-of-meeting"', True), ('p class="footer-text share-price"', True), ('h2 id="comments-on-kant"', True), ('div class="cookieRecipe"', True), ('span class="nav-text"', True),
    ('div class="main-menu"', False), ('div class="ad"', False), ('div class="ad-box-2"', False), ('div id="commentsSection"', False), ('ul class="nav nav-list"', False), ('p class="advert"', False),
    ('div class="cookie-bar"', False), ('div class="x sidebar-left"', False), ('div class="newsletter-form"', False), ('li class="share"', False),
])
def test_names_of_chrome_inside_an_article(element, kept):
    page = f"<body><nav>menu</nav><article><p>before</p><{element}>own text</{element.split()[0]}><p>after</article>"
    lines = [t for t, article, chrome in html_text.blocks(page) if article and not chrome]
    assert " ".join(lines).split() == ("before own text after" if kept else "before after").split()


def test_suffix_order_agrees_with_sorting():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 8):
        tokens, owner = rng.integers(0, 3, 200).astype(np.uint64), np.sort(rng.integers(0, 5, 200))
        order, rank = html_text.suffix_order(tokens, owner, depth)
        ends = np.searchsorted(owner, owner, side="right")
        whole = [i for i in order if i + depth <= ends[i]]
        assert sorted(whole) == [i for i in range(200) if i + depth <= ends[i]]
        for a in whole:
            for b in whole:
                assert (rank[a] == rank[b]) == bool((tokens[a:a + depth] == tokens[b:b + depth]).all())


def test_pieces(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    rows = [(1, None), (2, ""), (3, " "), (None, "a  b\n\tc"), (4, "x" * 700), (4, "的中国😀é́ " * 40), (5, "word " * 300), (6, "word " * 300), (7, "a▁b"), (8, "<s><0x0A>" * 30), (9, " " * 400)]
    for chunk in (7, 50, 1 << 15):
        found = by_id(pieces.encode(documents(spark, rows), SENTENCEPIECE_MODEL, chunk=chunk))
        assert sum(map(len, found.values())) == len(rows)
        for i in found:
            assert sorted(list(r.ids) for r in found[i]) == sorted(model.encode(t or "") for j, t in rows if j == i)
            assert all(r.round_trip == (i != 7) for r in found[i])
    encoded = pieces.encode(documents(spark, rows), SENTENCEPIECE_MODEL)
    assert {r.doc_id: r.text for r in pieces.decode(encoded.filter("doc_id in (1, 3, 7, 9)"), SENTENCEPIECE_MODEL).collect()} == {1: "", 3: " ", 7: "a b", 9: " " * 400}


def test_transfers_combine_associatively():
    vocabulary = pieces.read_vocabulary(SENTENCEPIECE_MODEL)
    text = pieces.marked("international the   aaaaaaaa of" * 3)
    cut = [(text[max(0, a - vocabulary.longest):a], text[a:a + 9], text[a + 9:a + 9 + vocabulary.longest], a == 0, a + 9 >= len(text)) for a in range(0, len(text), 9)]
    m = [pieces.transfer(vocabulary, *c) for c in cut]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.combine(left, x)
    for x in reversed(m[:-1]):
        right = pieces.combine(x, right)
    assert left.shape == (1, 1) and left[0, 0] == right[0, 0] == 0.0


class _Held:
    def __init__(self, value):
        self.value = value


def test_lattice_weights_and_paths_equal_merging():
    vocabulary = pieces.read_vocabulary(SENTENCEPIECE_MODEL)
    lattice = pieces.Lattice(vocabulary)
    rng = np.random.default_rng(4)
    stable = np.array([i for p, i in vocabulary.ids.items() if len(vocabulary.merge(p, least=2)) <= 2])
    a, b = rng.choice(stable, 20000), rng.choice(stable, 20000)
    words = ["▁" + "".join(rng.choice(list("etaoinsht的中é😀▁0"), rng.integers(0, 30))) for _ in range(500)] + ["▁international", ""]
    split = [vocabulary.merge(w) for w in words]
    near = [(vocabulary.ids[x], vocabulary.ids[y]) for parts in split for x, y in zip(parts, parts[1:]) if x in vocabulary.ids and y in vocabulary.ids]
    a, b = np.append(a, [x for x, _ in near]), np.append(b, [y for _, y in near])
    expected = [vocabulary.merge(vocabulary.names[x] + vocabulary.names[y]) == [vocabulary.names[x], vocabulary.names[y]] for x, y in zip(a, b)]
    assert lattice.follows(a, b).tolist() == expected and not all(expected)
    ids, sizes = lattice.encoded(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[i for p in parts for i in vocabulary.numbers(p)] for parts in split]


def test_texts_of_one_chunk_go_through_the_lattice_and_are_decoded():
    vocabulary = pieces.read_vocabulary(SENTENCEPIECE_MODEL)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4]), "text": ["the end", "an end", "a▁ b", None]})

    def rows(vocabulary, lattice):
        return pa.Table.from_batches(pieces._whole(_Held(vocabulary), _Held(lattice), True)(iter([batch]))).to_pylist()

    lattice, asked = pieces.Lattice(vocabulary), []
    follows = lattice.follows
    lattice.follows = lambda a, b: asked.append(len(a)) or follows(a, b)
    assert [r["round_trip"] for r in rows(vocabulary, lattice)] == [True, True, False, True] and sum(asked) > 0
    assert [r["ids"] for r in rows(vocabulary, lattice)] == [pieces.encode_text(vocabulary, t) for t in ("the end", "an end", "a▁ b", "")]
    vocabulary.raw[vocabulary.ids["▁the"]] = "▁teh".encode()
    assert [r["round_trip"] for r in rows(vocabulary, lattice)] == [False, True, False, True]


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert line_dedup.drop_repeated_lines(docs).count() == 0
    assert secrets.find_secrets(docs).count() == 0
    assert substring_dedup.remove_repeated_windows(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert pieces.encode(docs, SENTENCEPIECE_MODEL).count() == 0
    assert language.identify(language.document_records(docs), ["doc_id"]).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(documents(spark, [(1, "some text " * 20)]), items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(pages).count() == 0
    folder = scratch_folder(spark, "warc")
    assert warc.write_archives(pages, folder).count() == warc.read_archives(spark, folder).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(vectors, vectors).count() == 0


def test_stages_of_the_pipeline_on_odd_rows(spark):
    base = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    odd = base.limit(40).unionByName(spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, base.first().text, None, None, None)], SCHEMA)).withColumn("row", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, TESTDATA)
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
