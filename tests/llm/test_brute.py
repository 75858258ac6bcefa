"""The registered queries and the pipeline's stages against brute force, over a small table of documents written as Parquet."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corvane.llm import licences, lm, media, mixing, mtree, neardup, packing, queries, quality, repeats, secrets, simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(200)] + ["Été", "don't", "$$$", "Foo,"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    passage = text(120)
    rows = []
    for i in range(120):
        body = text(rnd.randint(1, 150))
        if i % 9 == 0:
            body = body + " " + passage + " " + text(5)
        if i % 10 == 3:
            body = "BUY!! NOW$$$ ### CLICK!! " * rnd.randint(3, 20)
        if i % 14 == 5:
            body += f' password = "hunter{i}Secret9x" and later hunter{i}Secret9x again'
        if i % 12 == 7:
            body += " token=sharedExample1234"
        rows.append((i, body, "en", f"src{min(i % 7, 3)}", len(body)))
    rows += [(120 + k, rows[k][1], "en", "src9", 0) for k in range(5)]  # exact copies
    rows += [(130 + k, rows[40 + k][1].replace("w1 ", "v1 ", 1) + " tail", "fr", None, 0) for k in range(5)]  # near copies
    rows += [(140, None, None, None, None), (141, "", "en", "src0", 0), (142, " \n ", "en", "src0", 3), (None, text(30), "en", "src1", 0), (7, rows[7][1], "en", "src0", 0), (143, text(9000), "en", "src0", 0), (143, "a", "en", "src0", 1)]
    return rows


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 10 != 3), 0) for r in rows[:120] if r[0] % 5 < 4], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = np.random.default_rng(2)
    spark.createDataFrame([(i, [float(np.float32(x)) for x in rng.normal(size=8)], 0) for i in range(90)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def run(name, spark, sf_dir):
    return queries.queries()[name](spark, sf_dir).toPandas()


def test_op1_targets_and_reruns(spark, sf_dir):
    size = lambda t: len(WORD.findall((t or "").encode()))
    own = defaultdict(int)
    for r in corpus():
        own[r[3]] += size(r[1])
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(own.values()), set(names), {}
    while True:  # those above their bound get it, the rest is dealt again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * own[s]}
        if not over:
            break
        target |= {s: 2 * own[s] for s in over}
        left -= sum(2 * own[s] for s in over)
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    found = run("op1_cube_mixing", spark, sf_dir)
    assert len(found) == len(corpus())
    for s, group in found.groupby(found.source.fillna("~")):
        s = None if s == "~" else s
        assert group.target.iloc[0] == pytest.approx(target[s]) and group.source_size.iloc[0] == own[s]
        assert abs(group.taken.sum() - target[s]) <= max(20, 0.02 * target[s])
    assert (found.taken <= 2 * found["size"]).all()
    again = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).toPandas()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert found[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_op1_copies_spread_over_strata(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 500 + [(i, "x " * i, "s") for i in range(40)], "doc_id long, text string, source string")
    tags = [r.tag for r in mixing.sized(df).select("tag").collect()]
    assert len(set(tags)) == 540


def test_op2_long_texts_in_pieces(spark):
    rnd = random.Random(8)
    long = " ".join(f"{rnd.randrange(10**6)}" for _ in range(3000))
    df = spark.createDataFrame(list(enumerate([long, "x" + long[7000:8000], long[100:500], "short"])), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).collect()} == {0: 1400, 1: 1000, 2: 400, 3: 0}
    assert {part[0][1] for part in repeats._pieces(iter([(0, b"a" * (repeats.PIECE + 500))]), 400)} == {0, repeats.PIECE}


def test_op2_passages(spark):
    rnd = random.Random(12)
    text = lambda n: " ".join(f"{rnd.randrange(10**5)}" for _ in range(n))
    long, short = text(55), text(48)
    texts = [text(30) + " " + long + " " + text(20), long, text(9) + " " + short, short + " " + text(60), text(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.passage_words for r in repeats.remove_repeats(df, passage=repeats.PASSAGE).collect()}
    assert 53 <= found[0] <= 57 and found[1] == 55 and not any(found[i] for i in (2, 3, 4))


def test_op2_the_transform_and_its_prefixes(tmp_path):
    rnd = random.Random(9)
    texts = [bytes(rnd.choices(b"ab", k=12)) for _ in range(40)] + [b"abababababab"] * 2
    texts.sort(key=lambda t: t[:1])
    group = np.array([t[0] == ord("b") for t in texts]).astype(int)
    table = np.array([list(t) for t in texts], np.uint8).T.copy()
    bwt = repeats.ColumnBwt(group, table, np.zeros(len(texts), int), np.full(len(texts), 12), str(tmp_path))
    for c in reversed(range(12)):
        bwt.insert(c)
    for k in range(13):
        c = 12 - k
        order = bwt.section("order", k, np.int32)
        suffix = [(group[i], texts[i][c:]) for i in order]
        assert suffix == sorted(suffix)
        prefix = [0] + [len(os.path.commonprefix([a[1], b[1]])) if a[0] == b[0] else 0 for a, b in zip(suffix, suffix[1:])]
        assert bwt.section("prefixes", k, np.int16).tolist() == prefix
        if c:
            assert bwt.section("transform", k, np.uint16).tolist() == [texts[i][c - 1] for i in order]
    bwt.close()


def test_op2_divided_anchors(spark):
    """One anchor with far more stretches than a task takes: the same spans as undivided."""
    rnd = random.Random(10)
    form = " ".join(f"{rnd.randrange(10**6)}" for _ in range(30))
    texts = [f"{rnd.randrange(10**9)} {form} {rnd.randrange(10**3)} {rnd.randrange(50)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = (sorted(map(tuple, repeats.remove_repeats(df, 60, 20, crowd).drop("kept").collect())) for crowd in (10_000, 4))
    assert one == two and sum(r[2] for r in one) > 0


def test_op3_keeps_by_weight(spark, sf_dir):
    found = run("op3_importance_resampling", spark, sf_dir)
    assert len(found) == len(corpus())
    grams = quality.Grams()
    labels = {r[0]: int(r[0] % 10 != 3) for r in corpus()[:120] if r[0] % 5 < 4}
    raw, target = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for r in corpus():
        g = grams(r[1])
        np.add.at(raw, g, 1)
        if labels.get(r[0]):
            np.add.at(target, g, 1)
    ratio = (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)
    want = sorted((-1 if r[0] is None else r[0], round(float(ratio[grams(r[1])].sum(dtype=float)), 4)) for r in corpus())
    assert sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), round(r.log_weight, 4)) for r in found.itertuples()) == want
    # what stays has the highest sums of weight and noise: far-off weights decide, and bad documents go
    assert found[found.kept].log_weight.min() > found[~found.kept].log_weight.max() - 25
    bad = {r[0] for r in corpus()[:120] if r[0] % 10 == 3}
    assert not bad & set(found[found.kept].doc_id.dropna().astype(int))


def test_op4_brute_force(spark, sf_dir):
    def fingerprint(t):
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        if not w:
            return 0
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [(r[0], fingerprint(r[1])) for r in corpus()]
    root = list(range(len(prints)))
    for _ in prints:
        new = [min(root[j] for j in range(len(prints)) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2) for i in range(len(prints))]
        if new == root:
            break
        root = new
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root[i]] = min(least.get(root[i], doc), doc)
    want = sorted((-1 if d is None else d, f"{p:016x}", least.get(root[i], -1)) for i, (d, p) in enumerate(prints))
    found = simhash.op4_simhash_golay(spark, sf_dir).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in found) == want


def test_op5_pieces_hold_the_ids(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus()]
    found = run("op5_bounded_packing", spark, sf_dir)
    assert found.length.sum() == sum(len(x) for _, x in ids)
    by = defaultdict(list)
    for d, x in ids:
        by[-1 if d is None else d].append(np.array(x, "<u4"))
    for r in found.itertuples():
        doc = -1 if r.doc_id is None or np.isnan(r.doc_id) else int(r.doc_id)
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by[doc])
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096 and (g.offset == g.length.cumsum() - g.length).all()


def test_op6_brute_force(spark, sf_dir):
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = []
    for q, x in rows:
        if q % 20 == 0:
            order = sorted((-int(x @ y), c) for c, y in rows if c != q)[:20]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(order, 1)]
    found = mtree.op6_mtree_topk(spark, sf_dir).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)


def test_op7_against_the_model(spark, sf_dir):
    docs = [(r[0], [*re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r[1] or "").encode()).split(), b""]) for r in corpus()]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    one, two = Counter(), Counter()
    start = "start"
    for d, t in docs:
        if not held(d):
            one.update(t)
            one[start] += 1
            two.update(zip([start, *t], t))
    n = sum(c for w, c in one.items() if w != start)
    v = len(one) - 1
    base = lambda w: ((one[w] if w != start else 0) + 0.1) / (n + 0.1 * (v + 1))
    sums = np.zeros((len(lm.GRID) + 1, 65))
    for (a, b), c in two.items():
        bucket = max(2, math.frexp(one[a])[1])
        rough = 10.0 ** (np.clip(round(-25 * math.log10(base(b))), 0, 255) / -25)
        for k, m in enumerate(lm.GRID):
            sums[k, bucket] += c * math.log((c - 1 + m * rough) / (one[a] - 1 + m))
        sums[-1, bucket] += 1
    weight = lm.best_weights(sums)
    want = []
    for d, t in docs:
        total = 0.0
        for a, b in zip([start, *t], t):
            m = weight[math.frexp(max(one[a], 1))[1]]
            total += math.log10((two[a, b] + m * base(b)) / (one[a] + m) if one[a] else base(b))
        want.append((-1 if d is None else d, len(t), total))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in lm.op7_eliasfano_lm(spark, sf_dir).collect())
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-3)


def whole(name):
    return next(t for n, t in licences.KNOWN if n == name)


def test_op8_entire_files(spark):
    mit, bsd = whole("MIT"), whole("BSD-3-Clause")
    files = [
        ("MIT", "MIT License\n\nCopyright (c) 2011-2020 Jane Roe <jane@example.org>\n\n" + mit),
        ("MIT", "The MIT License (MIT)\n\n(c) 1999 ACME\n" + mit.upper()),
        ("MIT", "/*\n * " + mit.replace("\n", "\n * ").replace('"', "“") + "\n */"),
        ("MIT", mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(". ", ".\n")),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2020, The Authors\nAll rights reserved.\n\n" + bsd.replace("1. ", "  1) ").replace("2. ", "  2) ").replace("3. ", "  3) ")),
        ("BSD-2-Clause", "Copyright (C) 2001 X. All rights reserved.\n\n" + whole("BSD-2-Clause")),
        (None, mit + " One more condition: none."),
        (None, mit.replace("without restriction", "with restrictions")),
        (None, ""),
        (None, None),
    ]
    for name, file in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")):
        if os.path.exists(path := f"/usr/share/common-licenses/{file}"):
            with open(path) as f:
                files.append((name, f.read().replace(",", " , ")))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    want = [n for n, _ in files]
    assert [r.licence_id for r in licences.scan_licences(df).orderBy("doc_id").collect()] == want
    table = licences.licence_table(spark.createDataFrame([("own", mit)], "licence_id string, licence_text string"))
    assert [r.licence_id for r in licences.match_licences(df, table).orderBy("doc_id").collect()] == ["own" if n == "MIT" else None for n in want]


def test_op9_ownership(spark, sf_dir):
    owners = defaultdict(set)
    for r in corpus():
        for m in re.finditer(secrets.ASSIGN, r[1] or ""):
            owners[m[2]].add(r[3])
    found = {}
    for r in secrets.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        found.setdefault(r.doc_id, []).append(r)
    for d, text, *_ in corpus()[:120]:
        spans = [s for r in found[d] for s in r.spans]
        assigned = [m for m in re.finditer(secrets.ASSIGN, text)]
        assert len([s for s in spans if s["kind"] == 0]) == len(assigned) * len(found[d])
        for s in spans:
            if s["kind"] == 0:
                m = next(m for m in assigned if m.start() == s["start"])
                n = len(owners[m[2]])
                assert s["owners"] == n and s["class"] == ("example" if n >= 3 else "live" if n == 1 else "unclear")
        bare = [text[s["start"] : s["end"]] for s in spans if s["kind"] == 3]
        want = [f"hunter{d}Secret9x"] * len(found[d]) if d % 14 == 5 and d % 10 != 3 and len(owners[f"hunter{d}Secret9x"]) == 1 else None
        if want:
            assert bare == want
        elif d % 14 != 5:
            assert not bare
    told = secrets.op9_secret_ownership(spark, sf_dir).collect()
    assert any("owned:" in r.spans for r in told) and all(len(list(filter(None, r.classes.split(",")))) == len(list(filter(None, r.spans.split(",")))) for r in told)


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def movie(stsz=(3, 5, 2, 7), sync=(1, 3), chunks=((1, 2, 1),), fragment=False):
    """A file with one video track of given sample sizes, two samples a chunk."""
    table = lambda kind, rows: box(kind, bytes(4), struct.pack(">I", len(rows)), *[struct.pack(f">{len(r)}I", *r) for r in rows])
    entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), bytes(50))

    def moov(first):
        offsets = [first, first + sum(stsz[:2])] if stsz else []
        stbl = box(b"stbl", box(b"stsd", bytes(4), struct.pack(">I", 1), entry), table(b"stts", [(len(stsz), 10)] * bool(stsz)), table(b"ctts", [(len(stsz), 4)] * bool(stsz)), table(b"stsc", chunks if stsz else []), box(b"stsz", bytes(4), struct.pack(">II", 0, len(stsz)), struct.pack(f">{len(stsz)}I", *stsz)), table(b"stco", [(o,) for o in offsets]), table(b"stss", [(s,) for s in sync]))
        mdia = box(b"mdia", box(b"mdhd", bytes(12), struct.pack(">II", 100, 10 * len(stsz)), bytes(4)), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", stbl))
        mvex = box(b"mvex", box(b"trex", bytes(4), struct.pack(">IIIII", 1, 1, 10, 6, 0x10000))) * fragment
        return box(b"moov", box(b"trak", box(b"tkhd", bytes(12), struct.pack(">I", 1), bytes(68)), mdia), mvex)

    head = box(b"ftyp", b"isom", bytes(4))
    out = head + moov(len(head) + len(moov(0)) + 8) + box(b"mdat", bytes(sum(stsz)))
    if fragment:
        run = lambda start: box(b"trun", struct.pack(">IIiI", 0x5, 3, start, 0))
        moof = lambda start: box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", box(b"tfhd", bytes(4), struct.pack(">I", 1)), run(start)))
        out += moof(len(moof(0)) + 8) + box(b"mdat", bytes(18))
    return out


def test_op10_video_and_fragments():
    data = movie()
    (t,) = media.tracks(data)
    start = data.index(b"mdat") + 4
    assert (t["codec"], t["width"], t["height"], t["samples"], t["duration"], t["shift"]) == ("avc1", 640, 360, 4, 40, 4)
    assert t["keyframes"].tolist() == [[start, 8], [start + 8, 9]]
    data = movie((), (), (), fragment=True)
    (t,) = media.tracks(data)
    assert t["samples"] == 3 and t["duration"] == 30 and t["keyframes"].tolist() == [[data.rindex(b"mdat") + 4, 6]]


def test_op10_malformed_files_are_rows(spark):
    good = movie()
    rnd = random.Random(3)
    files = [movie(chunks=((9, 2, 1),)), movie(sync=(1, 99999)), movie(sync=(0,)), movie(sync=(3, 1)), movie(chunks=()), good[:-3], good[:200], b"", box(b"moov") , box(b"moov", *[b""]) + b"\0" * 5]
    for _ in range(200):
        x = bytearray(good)
        for _ in range(rnd.randint(1, 4)):
            x[rnd.randrange(len(x))] = rnd.randrange(256)
        files.append(bytes(x))
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate([*files, good])], "id long, data binary")
    found = media.media_columns(df, "data", "id").orderBy("id").collect()
    assert len(found) == len(files) + 1 and found[-1].error is None and found[-1].tracks[0].width == 640
    assert all(r.error for r in found[:10])
    assert all(k.length >= 0 for r in found if r.keyframes for k in r.keyframes)


def test_op10_features_of_texts(spark, sf_dir):
    for r in media.op10_media_columns(spark, sf_dir).collect():
        pass
    want = []
    for d, t, *_ in corpus():
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.encode(full)
        want.append((-1 if d is None else d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    found = media.op10_media_columns(spark, sf_dir).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in found) == sorted(want)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLUMNS).collect())))


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.lit(5)).withColumn("Times", F.lit("t")).withColumn("spans", F.lit(1))
    kept = pipeline.classify(spark, docs, sf_dir)
    by = Counter(repr((r.id, r.kept)) for r in quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect())
    assert kept.columns == docs.columns
    assert Counter(repr((r.doc_id, True)) for r in kept.collect()) == Counter({k: n for k, n in by.items() if "True" in k})

    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    left = pipeline.deduplicate(spark, docs, sf_dir)
    texts = [r.text for r in docs.select("text").collect()]
    sets = [frozenset(neardup.shingles((t or "").encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        new = [min(root[j] for j in range(len(texts)) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(texts))]
        if new == root:
            break
        root = new
    assert left.count() == len(set(root)) and left.columns == docs.columns

    clean = pipeline.redact(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    owners = defaultdict(set)
    for r in corpus():
        for m in re.finditer(secrets.ASSIGN, r[1] or ""):
            owners[m[2]].add(r[3])
    for r in clean.collect():
        if r.text is not None:
            assert all(len(owners[m[2]]) >= 3 for m in re.finditer(secrets.ASSIGN, r.text) if len(m[2]) >= 6)
    untouched = Counter(r[1] for r in corpus() if not re.search(secrets.ASSIGN, r[1] or ""))
    assert not untouched - Counter(r.text for r in clean.collect())

    mixed = pipeline.mix(spark, docs, sf_dir)
    taken = mixing.mix(docs.withColumn("at", F.monotonically_increasing_id()), keep=("at",)).agg(F.sum("copies")).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == taken

    packed = pipeline.pack(spark, mixed, sf_dir)
    whole = packing.pack(mixed, __import__("public_tokenizers").path("word_bpe_49k.json"))
    assert packed.agg(F.sum("length")).first() == whole.agg(F.sum("length")).first()


def test_pipeline_on_empty_and_on_null(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none, null = docs.where("false"), docs.where("doc_id = 140")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
        found = stage(spark, null, sf_dir)
        assert found.count() == (1 if name != "mixing sources to target weights" else found.count())


def test_pipeline_whole(spark, sf_dir):
    found = pipeline.run(spark, sf_dir).toPandas()
    assert len(found) and found.length.min() >= 1 and found.groupby("sequence_id").length.sum().max() <= 4096
