"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n=60, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünïcode", "日本", "A-B", "don't", "  "]
    out = [None, "", " \n\t", "one", "One", "two words", "\n\n", "<|endoftext|> x", "x" * 3000, "word " * 4000]
    while len(out) < n:
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
        out.append(t)
        if r.random() < 0.3:
            out.append(t.upper() if r.random() < 0.3 else t + r.choice(["", " end", "\n"]))
        if r.random() < 0.3:
            out.append("a shared line of text\n" + t + "\nA shared LINE of text  ")
    return out[:n]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts())]
    return out + [(None, "a text without an id", None, None, None), (3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(i):
    return (1 << 63) - 1 if i is None else i


def fingerprint(text):
    words = [w for w in _split((text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _split(t):
    for c in WHITE:
        t = t.replace(c, " ")
    return t.split(" ")


def brute_components(prints, radius=2):
    """ids to (fingerprint, smallest id reachable)."""
    n = len(prints)
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                top[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 63), key(prints[i][0]))
    return sorted((str(prints[i][0]), f"{prints[i][1]:016x}", str(None if least[find(i)] == (1 << 63) - 1 else least[find(i)])) for i in range(n))


def test_simhash_groups(docs, rows, empty):
    from situ.llm.simhash import near_groups

    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_groups(docs.withColumn("fp", docs.lang)).collect())
    assert got == brute_components([(r[0], fingerprint(r[1])) for r in rows])
    assert near_groups(empty).count() == 0


def test_simhash_shards_are_dealt_again(spark, monkeypatch):
    from situ.llm import simhash
    from situ.llm.common import components

    r = random.Random(3)
    base = r.getrandbits(64)
    prints = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(simhash, "SHARD", 20)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    dealt = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert dealt.groupBy("shard").count().agg({"count": "max"}).first()[0] < 400
    links = dealt.repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(simhash._linked(2), "a long, b long")
    got = dict(tuple(x) for x in components(links).collect())
    want = brute_components([(p, p & (1 << 64) - 1) for p in signed])
    by = {}
    for i, _, c in want:
        by.setdefault(c, set()).add(int(i))
    groups = {}
    for p in signed:
        groups.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by.values()))


def test_bk_tree_finds_what_brute_force_finds():
    from situ.llm.simhash import BKTree

    r = random.Random(5)
    values = {r.getrandbits(12) for _ in range(300)}
    tree = BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.search(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_near_deduplicate_keeps_columns_and_one_of_each_group(docs, rows):
    from situ.llm.simhash import near_deduplicate

    out = near_deduplicate(docs)
    assert out.columns == docs.columns
    want = {c for _, _, c in brute_components([(r[0], fingerprint(r[1])) for r in rows])}
    assert {str(r.doc_id) for r in out.collect()} == want


@pytest.mark.parametrize("least_docs", [2, 3])
def test_line_deduplicate(docs, rows, empty, least_docs):
    from situ.llm.lines import line_deduplicate

    keyed = lambda line: line.strip(WHITE).translate(LOWER)
    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            where.setdefault(keyed(line), set()).add(key(i))
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(keyed(x)) < 10 or len(where[keyed(x)]) < least_docs or min(where[keyed(x)]) == key(i)]
        want.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    out = line_deduplicate(docs.withColumn("n_lines", docs.lang), 10, least_docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect()) == sorted(want)
    assert line_deduplicate(empty).count() == 0


def test_lines_of_rows_without_ids_and_a_line_that_all_have(spark):
    from situ.llm.lines import line_deduplicate

    shared = "A line that every document has"
    rows = [(i if i % 3 else None, f"{shared}\nown line number {i % 50}\n\n{shared.lower()} \n", "x") for i in range(3000)]
    first = {}
    for i, t, _ in rows:
        for line in t.split("\n"):
            first.setdefault(line.strip().lower(), set()).add(key(i))
    want = []
    for i, t, _ in rows:
        lines = t.split("\n")
        keyed = [x.strip().lower() for x in lines]
        kept = [x for x, k in zip(lines, keyed) if len(k) < 10 or len(first[k]) < 2 or min(first[k]) == key(i)]
        want.append((str(i), "\n".join(kept), 5, 5 - len(kept)))
    out = line_deduplicate(spark.createDataFrame(rows, "doc_id long, text string, __lost string").repartition(5)).collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out) == sorted(want)


def test_media_round_trip(docs, rows, empty):
    from situ.llm.media import media_digests, padded, probe_media, read_payload, store_texts, write_avi

    got = {(r.doc_id, r.payload_sha256): r for r in media_digests(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i, hashlib.sha256(full).hexdigest()]
        media = write_avi(padded(t))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(full), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert read_payload(media)[0] == full
    assert media_digests(empty).count() == 0
    stored = store_texts(docs, ["doc_id"]).union(docs.sparkSession.createDataFrame([(-1, bytearray(b"RIFFbad")), (-2, None)], "doc_id long, media binary"))
    probes = {r.doc_id: r.probe for r in probe_media(stored.withColumn("probe", stored.doc_id), payload=True).collect()}
    assert probes[-1].error and probes[-2].error == "no media" and bytes(probes[4].payload) == padded("One")


def brute_feature(payload):
    """The feature string of a stored payload, by loops over its bytes."""
    size = min(3072, len(payload))
    frames = [payload[i : i + size] for i in range(0, len(payload), size)]
    frames = [f + f[-1:] * (size - len(f)) for f in frames]
    cuts, recent = [0], [0.1]
    for i in range(1, len(frames)):
        d = sum(abs(sum(c >> 4 == b for c in frames[i]) - sum(c >> 4 == b for c in frames[i - 1])) for b in range(16)) / size / 2
        if d > 0.6 or d > 0.1 and d > 2 * sum(recent) / len(recent):
            cuts.append(i)
        else:
            recent = [*recent, d][-8:]
    clips = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(frames)])]
    mean = lambda a, b: sum(sum(f) / size for f in frames[a:b]) / (b - a)
    return f"{len(frames)} frames; " + ", ".join(f"{a / 25:.2f}-{b / 25:.2f}s@{mean(a, b):.3f}" for a, b in clips)


def test_media_features_against_brute_force(spark):
    from situ.llm.media import media_digests, padded

    r = random.Random(2)
    found = ["", "x", "plain words " * 2000, "".join(r.choice(["the cat sat ", "0000 9999 ", "ÄÖÜ日本"]) * r.randint(1, 400) for _ in range(40)), "A" * 3072 + "z" * 3072 + "\n" * 100]
    got = media_digests(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()
    assert {i: f.feature for i, f in ((x.doc_id, x) for x in got)} == {i: brute_feature(padded(t)) for i, t in enumerate(found)}
    assert any(f.feature.count("@") > 1 for f in got)


def test_media_hostile_and_tableless_files(spark):
    import struct

    from situ.llm import media

    deep = b""
    for _ in range(3000):
        deep = media._chunk(b"LIST", b"abcd" + deep)
    head = media._chunk(b"LIST", b"hdrl" + media._chunk(b"strh", b"vidsMJPG" + b"\0" * 48))
    huge = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([1] * 64)) + media._segment(0xC0, struct.pack(">BHHBBBB", 8, 65535, 65535, 1, 1, 0x11, 0)) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"\0\0\xff\xd9"
    files = [b"RIFF" + struct.pack("<I", len(x) + 4) + b"AVI " + x for x in (deep, head + media._chunk(b"LIST", b"movi" + media._chunk(b"00dc", huge)), deep + head + media._chunk(b"LIST", b"movi"))]
    good = media.write_avi(media.padded("A" * 3072 + "z" * 6144))
    table = spark.createDataFrame([*((i, bytearray(f), 5) for i, f in enumerate(files)), (8, None, 5), (9, bytearray(good), 5)], "doc_id long, media binary, clip int")
    rows = {i: [r for r in media.media_clips(table).collect() if r.doc_id == i] for i in (0, 1, 2, 8, 9)}
    assert [len(v) for v in rows.values()] == [1, 1, 1, 1, 2] and rows[0][0].error and "too soon" in rows[1][0].error and rows[8][0].error == "no media"
    assert [(r.clip, r.start_s, r.end_s, r.first_frame, r.last_frame, r.mean) for r in rows[9]] == [(0, 0.0, 0.04, 0, 0, 65.0), (1, 0.04, 0.12, 1, 2, 122.0)]
    # An image that Java encoded, with its tables cut out, decodes to what Java decodes.
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(40, 24, 10)
    for y in range(24):
        for x in range(40):
            image.getRaster().setSample(x, y, 0, (x * 5 + y * y) % 256)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data, at = bytes(out.toByteArray()), 2
    kept = data[:2]
    while data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0] + 2
        kept += b"" if data[at + 1] == 0xC4 else data[at : at + size]
        at += size
    theirs = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data))).getRaster()
    want = np.array([[theirs.getSample(x, y, 0) for x in range(40)] for y in range(24)])
    assert len(kept) < len(data) - at - 300 + at and np.abs(media.decode_frame(kept + data[at:]).astype(int) - want).max() <= 1


def test_media_shots_and_baseline_frames():
    from situ.llm import media

    dark, light = np.full((8, 8), 10, np.uint8), np.full((8, 8), 200, np.uint8)
    assert media.shots([dark] * 5 + [light] * 4) == [(0, 4), (5, 8)]
    assert media.shots([dark, light, light, dark, light]) == [(0, 0), (1, 2), (3, 3), (4, 4)]
    assert media.shots([]) == []
    # A grey baseline frame of two blocks: DC 80 * quant 1, then the same; all AC zero.
    dht = media._segment(0xC4, b"\x00" + bytes([0, 2] + [0] * 14) + bytes([7, 0])) + media._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + bytes([0]))
    head = media._segment(0xDB, b"\0" + bytes([1] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + dht + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = "00" + f"{80:07b}" + "0" + "01" + "0"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    assert (media.decode_frame(b"\xff\xd8" + head + data + b"\xff\xd9") == np.full((8, 16), 138, np.uint8)).all()
    # A lossless frame with another table goes bit by bit.
    counts = bytes([0, 0, 0, 9] + [0] * 12)
    codes = media._table(counts, bytes(range(9)))
    samples, bits, left = np.arange(64, dtype=np.uint8).reshape(8, 8), "", {v: k for k, v in codes.items()}
    for y in range(8):
        for x in range(8):
            d = int(samples[y, x]) - (int(samples[y, x - 1]) if x else int(samples[y - 1, 0]) if y else 128)
            k = abs(d).bit_length()
            n, code = left[k]
            bits += f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << k) - 1:0{k}b}" if k else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = media._segment(0xC3, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + media._segment(0xC4, b"\0" + counts + bytes(range(9))) + media._segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    assert (media.decode_frame(b"\xff\xd8" + head + data + b"\xff\xd9") == samples).all()


def brute_mixture(counts, weights, block):
    """(source, block, slot, release, deadline) of every block, slot by slot: earliest deadline first among those released."""
    from fractions import Fraction

    w = {s: Fraction(str(weights.get(s, 1))) for s in counts}
    total = sum(w.values())
    left = {s: -(-c // block) for s, c in counts.items()}
    done, out, slot = dict.fromkeys(counts, 0), [], 0
    while any(done[s] < left[s] for s in counts):
        ready = [(math.ceil((done[s] + 1) * total / w[s]), -w[s], s) for s in counts if math.floor(done[s] * total / w[s]) <= slot]
        if ready:
            deadline, _, s = min(ready)
            assert slot < deadline and all(abs(done[x] + (x == s) - (slot + 1) * w[x] / total) < 1 for x in counts)
            if done[s] < left[s]:
                out.append((s, done[s], slot, math.floor(done[s] * total / w[s]), deadline))
            done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("most_runs", [1 << 20, 3])
@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 2}, {"": 5}, {"s0": 0.37, "s2": "0.5"}])
def test_mixing(docs, rows, empty, weights, most_runs, monkeypatch):
    from situ.llm import mixing

    monkeypatch.setattr(mixing, "MOST_RUNS", most_runs)
    pairs = sorted({(r[3] or "", key(r[0])) for r in rows})
    counts = {s: sum(x == s for x, _ in pairs) for s, _ in pairs}
    order = []
    for s, b, slot, release, deadline in brute_mixture(counts, weights or {}, 4):
        for i in [i for x, i in pairs if x == s][4 * b : 4 * b + 4]:
            order.append((len(order), s, i, b, slot, release, deadline))
    got = mixing.schedule(docs, weights, 4).collect()
    assert sorted((r.position, r.source, key(r.doc_id), r.block_id, r.slot, r.release, r.deadline) for r in got) == order
    assert mixing.schedule(empty).count() == 0
    out = mixing.mix(docs, weights, 4)
    place = {(s, i): n for n, s, i, *_ in order}
    mixed = [place[r.source or "", key(r.doc_id)] for r in out.collect()]
    assert out.columns == docs.columns and mixed == sorted(place[r[3] or "", key(r[0])] for r in rows)
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"s0": 0})


def test_periods_of_many_sources_and_large_weights():
    from situ.llm.mixing import Shares

    many = Shares([f"s{i:05}" for i in range(10_000)], {"s00007": 2, "s00009": 2})
    assert many.total == 10_002 and sum(n for _, _, n in many.runs()) == 10_002 and len(list(many.runs())) < 10
    assert Shares(["a", "b"], {"a": 1_500_000, "b": 4_500_000}).total == 4
    fine = Shares(list("abc"), {"a": 1_000_003, "b": 7, "c": 19})
    counts, order = dict.fromkeys("abc", 0), {}
    for first, start, n in fine.runs(3000):
        order.update(zip(range(start, start + n), range(first, first + n)))
    for slot in range(3000):
        s = next(s for s, (w, at, step) in fine.jobs.items() if at <= order[slot] < at + w)
        assert order[slot] == fine.jobs[s][1] + counts[s]
        counts[s] += 1
        assert all(abs(counts[x] - (slot + 1) * w / fine.total) < 1 for x, (w, _, _) in fine.jobs.items())


def test_url_verdicts(spark):
    from situ.llm import urls
    from situ.llm.queries import RULES

    found = ["http://a.Example.NET/en/x", "https://net/", "http://xnet/", "net/x", None, "", "http://b.example.com/de/?q", "http://example.com/de", "ftp://q.org/fr/#z", "http://Q.org/FR/", "a://b://net/", "http://net", "http://net", "http://x.net/#/en/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(found)] + [(1, found[1], "x")], "page_id long, url string, rule string")

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = rest[:at].translate(LOWER), rest[at:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(r), r, a) for r, a in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    for most in (urls.MOST_BLOCKS, 0):
        urls.MOST_BLOCKS, old = most, urls.MOST_BLOCKS
        got = urls.url_verdicts(pages, urls.rule_table(spark, RULES)).collect()
        urls.MOST_BLOCKS = old
        assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((i, *brute(u)) for i, u in [*enumerate(found), (1, found[1])])))
    long = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "net/"), (2, "http://" + "a." * 100_000 + "/"), (3, "http://x.net/" + "p" * 1_000_000)], "page_id long, url string")
    assert [r.verdict for r in urls.url_verdicts(long, urls.rule_table(spark, RULES)).orderBy("page_id").collect()] == ["block", "allow", "block"]
    many = urls.rule_table(spark, [(f"h{i}.org/", "block") for i in range(3000)])
    got = urls.url_verdicts(spark.createDataFrame([(i, f"http://www.h{i}.org/a") for i in range(0, 6000, 50)], "page_id long, url string"), many).collect()
    assert all((r.verdict == "block") == (r.page_id < 3000) for r in got) and len(got) == 120
    assert urls.url_verdicts(pages, many.where("false")).where("verdict = 'allow' and rule is null").count() == pages.count()


def test_url_verdicts_with_a_million_rules(spark):
    import time

    from situ.llm import urls

    began = time.time()
    rules = spark.range(1_000_000).selectExpr("concat('h', id, '.org/', IF(id % 2 = 0, 'a/', '')) AS rule", "concat('h', id, '.org') AS host", "IF(id % 2 = 0, '/a/', '/') AS path", "'block' AS action")
    pages = spark.range(2_000_000, 0, -1000).selectExpr("id AS page_id", "concat('http://www.h', id, '.org/a/x') AS url")
    got = urls.url_verdicts(pages, rules).groupBy("verdict").count().collect()
    assert dict(map(tuple, got)) == {"block": 999, "allow": 1001} and time.time() - began < 60


def test_pseudonyms(docs, rows, empty):
    from situ.llm.pii import KINDS, luhn, pseudonymise, pseudonyms

    key1 = b"k1"
    card = "411111111111111" + str(luhn("411111111111111"))
    samples = [card, "4111-1111-1111-1111", "+1 (456) 555-2186", "212-555-0100", "78.118.65.158", "2024-02-29", "31/12/1999", "12/31/1999", "123-45-6789", "DE89 3704 0044 0532 0130 00", "jo.do22@mail7.example.com"]
    for s in samples:
        text, counts = pseudonymise(f"see {s}, and {s}.", key1)
        a, b = text[4:-1].split(", and ")
        assert a == b != s and len(a) == len(s) and sum(counts.values()) == 2, s
        assert [c.isdigit() for c in a] == [c.isdigit() for c in s] or "." in s, s
        assert pseudonymise(s, b"k2")[0] != a and pseudonymise(f"x {s}", key1)[0] == f"x {a}"
    d = pseudonymise(card, key1)[0]
    assert luhn(d[:-1]) == int(d[-1]) and d[0] == "4"
    for s in ("4111111111111112", "999.1.1.1", "2023-02-30", "666-45-6789", "1234567", "a@b", "version 1.2.3", "plain words only"):
        assert pseudonymise(s, key1) == (s, {})
    out = pseudonyms(docs.withColumn("n_card", docs.lang), key1)
    assert sorted(map(str, ((r.doc_id, r.text, r.n_replaced) for r in out.collect()))) == sorted(str((r[0], r[1], 0)) for r in rows)
    assert {f"n_{k}" for k in KINDS} <= set(out.columns) and pseudonyms(empty, key1).count() == 0


def test_feistel_is_a_permutation():
    from situ.llm.pii import permute

    for size in (1, 2, 7, 100, 1000):
        assert sorted(permute(i, size, b"k", b"t") for i in range(size)) == list(range(size))


def test_dates_of_all_years_keep_their_format():
    import datetime

    from situ.llm.pii import Days, _date

    for digits in ((1, 1, 1), (2, 2, 1), (1, 2, 13), (2, 1, 1)):
        days, at = Days(*digits), 0
        for d in (datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(5 * 366)):
            if d.month < 10 ** digits[0] and digits[2] <= d.day < 10 ** digits[1]:
                assert days.day(days.place(d)) == (d.year, d.month, d.day) and days.place(d) == (at or days.place(d))
                at = days.place(d) + 1
        assert days.day(0)[0] == 1 and days.day(days.before(10_000) - 1)[0] == 9999
    r = random.Random(6)
    for shape in ("{d}/{m}/{y:04}", "{m}/{d}/{y:04}", "{y:04}-{m:02}-{d:02}", "{d:02}.{m:02}.{y:04}", "{y:04}/{m}/{d}"):
        made = {}
        for _ in range(300):
            day = datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3652059))
            old = shape.format(y=day.year, m=day.month, d=day.day)
            new = _date(old, b"k")
            assert new != old and [len(x) for x in new.replace("/", "-").replace(".", "-").split("-")] == [len(x) for x in old.replace("/", "-").replace(".", "-").split("-")]
            assert _date(new, b"k") and made.setdefault(new, old) == old
    assert _date("31/12/1899", b"k") != "31/12/1899" and _date("31/02/2020", b"k") is None and _date("0000-01-01", b"k") is None


def brute_permute(value, size, key, tweak):
    """A Feistel network of eight rounds on pairs of numbers, from its description."""
    root = 1
    while root * root < size:
        root *= 2
    width = (root.bit_length() - 1 + 7) // 8
    while True:
        a, b = divmod(value, root)
        for i in range(8):
            h = hashlib.blake2b(tweak + bytes([i]) + b.to_bytes(width, "big"), key=key, digest_size=width + 8).digest()
            a, b = b, a ^ int.from_bytes(h, "big") % root
        value = a * root + b
        if value < size:
            return value


def test_pseudonyms_against_brute_force():
    import ipaddress

    from situ.llm.pii import luhn, pseudonymise

    r, k = random.Random(12), b"secret"

    def card():
        body = r.choice("23456") + "".join(r.choice("0123456789") for _ in range(14))
        old = body + str(luhn(body))
        new = body[0] + str(brute_permute(int(old[1:-1]), 10**14, k, b"card16" + body[0].encode())).zfill(14)
        return old, new + str(next(d for d in range(10) if sum(sum(map(int, str(int(c) * (1 + (i % 2))))) for i, c in enumerate(reversed(new + str(d)))) % 10 == 0))

    def ip():
        n = r.randrange(1 << 32)
        return str(ipaddress.ip_address(n)), str(ipaddress.ip_address(brute_permute(n, 1 << 32, k, b"ip")))

    def ssn():
        every = [a for a in range(1, 900) if a != 666]
        a, g, s = r.choice(every), r.randint(1, 99), r.randint(1, 9999)
        n = brute_permute((every.index(a) * 99 + g - 1) * 9999 + s - 1, len(every) * 99 * 9999, k, b"ssn")
        return f"{a:03}-{g:02}-{s:04}", f"{every[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"

    def phone():
        n = r.randrange(2 * 10**9, 10**10)
        m = brute_permute(n - 2 * 10**9, 8 * 10**9, k, b"phone1") + 2 * 10**9
        return tuple(f"({str(x)[:3]}) {str(x)[3:6]}-{str(x)[6:]}" for x in (n, m))

    def odd_phone():
        n = r.randrange(2 * 10**9)
        m = brute_permute(n, 2 * 10**9, k, b"phone0")
        return tuple(f"+1 ({x[:3]}) {x[3:6]}-{x[6:]}" for x in (f"{n:010}", f"{m:010}"))

    def mail():
        letters = "abcdefghijklmnopqrstuvwxyz"
        n, size = r.randint(1, 8), 1
        local, value = "".join(r.choice(letters) for _ in range(n)), 0
        for c in local:
            value, size = value * 26 + letters.index(c), size * 26
        value, out = brute_permute(value, size, k, b"mailex.org" + b"a" * n), ""
        for _ in range(n):
            value, i = divmod(value, 26)
            out = letters[i] + out
        return f"{local}@ex.org", f"{out}@ex.org"

    kinds, plain = [card, ip, ssn, phone, odd_phone, mail], ["word", "a,", "version 1.2.3", "x@y", "12", "(see", "4111 1111 1111 1112", "999.1.1.1", "666-45-6789", "no.", "\n"]
    for _ in range(200):
        old, new, n = [], [], 0
        for _ in range(r.randint(0, 30)):
            if r.random() < 0.5:
                a, b = r.choice(kinds)()
                n += 1
            else:
                a = b = r.choice(plain)
            old += [a, "and"]
            new += [b, "and"]
        got, counts = pseudonymise(" ".join(old), k)
        assert got == " ".join(new) and sum(counts.values()) == n


def test_pseudonyms_of_very_long_runs():
    import time

    from situ.llm.pii import pseudonymise

    began = time.time()
    for text in ("a" * 1_000_000 + "@ x", "a@" * 300_000, "1" * 1_000_000, "12 " * 10_000, "x@" + "a." * 300_000, "1." * 200_000):
        assert pseudonymise(text, b"k")[0] == text
    assert time.time() - began < 30
    assert pseudonymise("a" * 64 + "@b.org", b"k")[1] == {"email": 1} and pseudonymise("a" * 65 + "@b.org", b"k")[1] == {}


def flat(t):
    return "".join(c for c in t or "" if c not in WHITE)


def brute_exact(rows, known=None):
    """Result rows as text, one kept row of those that repeat; ``known`` has the ids of texts that came before."""
    groups, seen, out = {}, set(), []
    for i, t, *_ in rows:
        groups.setdefault(flat(t), []).append((-len(t or ""), key(i)))
    for i, t, *_ in rows:
        f, n = flat(t), -len(t or "")
        best = min(groups[f])
        kept = f not in (known or {}) and (n, key(i)) == best and f not in seen
        if kept:
            seen.add(f)
        k = (known or {}).get(f, best[1])
        out.append(str((i, None if k == (1 << 63) - 1 else k, len(groups[f]), kept, hashlib.sha256(f.encode()).hexdigest())))
    return sorted(out)


def test_exact_groups_and_index(spark, docs, rows, empty, tmp_path):
    from situ.llm.exact import DigestIndex, exact_deduplicate, exact_groups

    got = lambda df: sorted(str(tuple(r)) for r in df.collect())
    texts = {flat(r[1]) for r in rows}
    index = DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert not index.exists() and index.rows().count() == 0
    assert got(exact_groups(docs.withColumn("digest", docs.lang), index, "one")) == brute_exact(rows)
    assert index.exists() and index.rows().count() == len(texts)
    # The same batch again, as after a failure, gives the same result and adds nothing.
    assert got(exact_groups(docs.repartition(2), index, "one")) == brute_exact(rows) and index.rows().count() == len(texts)
    # What another addition wrote before it failed is not seen.
    index.rows().selectExpr("concat('0', digest) digest", "id", "n_chars", "'bad' batch", "'lost' addition").repartition(4, "digest").write.mode("append").format("parquet").bucketBy(4, "digest").sortBy("digest").option("path", f"{index.path}/rows").saveAsTable(index.table)
    assert index.rows().count() == len(texts)
    # Another session, whose catalog knows nothing, goes on with the folder.
    known = {flat(r[1]): r[0] for r in rows}
    known = {f: min((-len(r[1] or ""), key(r[0])) for r in rows if flat(r[1]) == f)[1] for f in known}
    spark.sql(f"DROP TABLE {index.table}")
    later = DigestIndex(spark.newSession(), f"file://{tmp_path}/index", buckets=99)
    more = [(1000 + i, t, "en", "s", 0) for i, t in enumerate([*texts, "new text", "new  text", "NEW", "one"])] + [(None, "new text", "en", "s", 0)] * 3
    second = spark.createDataFrame(more, docs.schema).repartition(3)
    assert got(exact_groups(second, later, "two")) == brute_exact(more, known)
    assert later.rows().count() == len(texts) + 2 and later.buckets == 4
    assert exact_groups(docs, later).where("kept").count() == 0
    assert exact_groups(empty, later).count() == 0 and exact_groups(empty).count() == 0


def test_exact_deduplicate_keeps_one_row_of_each_text(docs, rows, empty):
    from situ.llm.exact import exact_deduplicate

    kept = exact_deduplicate(docs.withColumn("n", docs.lang).withColumn("__SHA", docs.lang))
    assert kept.columns == [*docs.columns, "n"]
    best = {}
    for i, t, *_ in rows:
        best[flat(t)] = min(best.get(flat(t), (1, 0)), (-len(t or ""), key(i)))
    assert sorted((-len(r.text or ""), key(r.doc_id)) for r in kept.collect()) == sorted(best.values())
    assert exact_deduplicate(docs.where("doc_id is null").union(docs.where("doc_id is null"))).count() == 1
    assert exact_deduplicate(empty).count() == 0


def test_exact_anti_join_is_sort_merge_without_shuffle_of_the_index(spark, docs):
    from situ.llm.exact import DigestIndex, exact_groups

    index = DigestIndex(spark, buckets=4)
    exact_groups(docs, index).count()
    new = spark.createDataFrame([("x", 1, 1)], "digest string, id long, n_chars long").repartition(4, "digest")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = new.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount" in plan


def test_hot_keys_are_broadcast(spark):
    from situ.llm.common import join_hot

    rows = spark.range(6000).selectExpr("IF(id < 4000, 0, id) AS k", "id")
    known = rows.groupBy("k").count()
    joined = join_hot(rows, known, ["k"], "count")
    assert "Union" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(known, "k").collect()))


def test_components_of_a_long_chain(spark):
    from situ.llm.common import components

    chain = spark.range(1 << 12).selectExpr("(id * 2654435761) % 4294967296 AS a", "((id + 1) * 2654435761) % 4294967296 AS b")
    assert [tuple(r) for r in components(chain).groupBy("component").count().collect()] == [(0, (1 << 12) + 1)]


def test_quality(spark, docs, empty):
    from situ.llm.quality import add_score, held_out, keep_good, train

    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioutnrsl") for _ in range(r.randint(2, 7)))
    good = [" ".join(word() for _ in range(r.randint(20, 60))) + "." for _ in range(200)]
    bad = [" ".join(word().upper() + "!!" for _ in range(r.randint(20, 60))) for _ in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    weights = train(table, labels)
    rows = add_score(table.withColumn("score", table.doc_id), weights).withColumn("h", held_out(table.doc_id)).where("doc_id is not null").collect()
    held = [x for x in rows if x.h]
    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((x.score >= 0.3) == (x.doc_id < 200) for x in held) / len(held) > 0.95
    scored = add_score(docs, weights).collect()
    assert len(scored) == docs.count() and all(0 <= x.score <= 1 for x in scored)
    assert add_score(empty, weights).count() == 0 and keep_good(docs, weights).columns == docs.columns
    assert set(train(empty, labels).tolist()) == {0.0}


def brute_features(text):
    """Counts of feature places of a text, word by word."""
    import unicodedata

    mask = (1 << 64) - 1
    m = 0x9E3779B97F4A7C15

    def mixed(a, b):
        x = (a ^ ((b * m + (a << 6)) & mask)) * m & mask
        return x ^ x >> 29

    def shape(w):
        kinds = ["X" if unicodedata.category(c) == "Lu" else "x" if unicodedata.category(c)[0] in "LM" else "9" if unicodedata.category(c)[0] == "N" else c for c in w]
        return "".join(k for i, k in enumerate(kinds) if not (i and k in "Xx9" and kinds[i - 1] == k and unicodedata.category(w[i])[0] in "LMN" and unicodedata.category(w[i - 1])[0] in "LMN"))

    words = [w for w in _split(text or "") if w]
    begin, out = 0x5E5E5E5E, {}
    word = [xxhash.xxh64_intdigest(w.translate(LOWER), 1) for w in words]
    kind = [0x3D3D3D3D if i and word[i] == word[i - 1] else xxhash.xxh64_intdigest(shape(w), 2) for i, w in enumerate(words)]
    for i in range(len(words)):
        k1, k2 = (kind[i - 1] if i else begin), (kind[i - 2] if i > 1 else begin)
        two = mixed(k1, kind[i])
        for h in (word[i], mixed(word[i - 1] if i else begin, word[i]), mixed(3, kind[i]), mixed(4, two), mixed(5, mixed(k2, two))):
            p = h >> 17 & (1 << 18) - 1
            out[p] = out.get(p, 0) + 1
    return out, len(words)


def test_quality_features_and_updates_against_brute_force():
    import pyarrow as pa

    from situ.llm import quality

    found = [*texts(), "AbC1x ÀÉé ße 1½٣ a-B--c  9x9", "Z" * 30 + "y" * 30, "-" * 40 + "A", "-" * 40 + "a", "x x X x"]
    places, counts = quality.features(pa.array(found, pa.string()))
    at = 0
    for t, n in zip(found, counts.tolist()):
        want, words = brute_features(t)
        got, times = np.unique(places[:, at : at + n], return_counts=True)
        assert n == words and dict(zip(got.tolist(), times.tolist())) == want, t
        at += n
    assert set(places[:, -6].tolist()) and brute_features("-" * 40 + "A") != brute_features("-" * 40 + "a")
    # Updates: per coordinate z and n as in the published algorithm, one example after the other.
    r = random.Random(8)
    examples = [({r.randrange(50): r.random() for _ in range(8)}, r.randint(0, 1)) for _ in range(200)]
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for x, y in examples:
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = quality.fit((np.array(list(x)), np.array(list(x.values())), y) for x, y in examples)
    assert np.allclose(got[:50], [weight(i) for i in range(50)], atol=1e-5) and not got[50:].any()
    # A score is the logistic function of the mean weight of a text's features, times five, and the bias.
    w = np.zeros(quality.SIZE + 1)
    w[: quality.SIZE] = np.random.default_rng(1).normal(size=quality.SIZE)
    w[-1] = 0.3
    for t, s in zip(found, quality.scores(pa.array(found, pa.string()), w).tolist()):
        f, words = brute_features(t)
        assert abs(s - 1 / (1 + math.exp(-max(-30, min(30, 0.3 + sum(w[i] * c for i, c in f.items()) / max(1, words)))))) < 1e-9


def encoded(text):
    from tokenizers import Tokenizer

    from situ.llm.tokens import default_tokenizer

    global _TOKENIZER
    try:
        _TOKENIZER
    except NameError:
        _TOKENIZER = Tokenizer.from_file(default_tokenizer())
    return _TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    import pyarrow as pa

    from situ.llm.tokens import Encoder, default_tokenizer

    r = random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "12", ". ", "\x1c", "\u3000", "\xa0", "<|endoftext|>", "日", "😀", " x", "\0", "\x01", "²", "_"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [None]
    code = Encoder(default_tokenizer())
    code._memo.entries = 50  # so that entries come and go
    for size in (1, 100):
        for a in range(0, len(odd), size):
            ids, ends = code.encode_array(pa.array(odd[a : a + size], pa.string()))
            for t, x, y in zip(odd[a : a + size], ends, ends[1:]):
                assert ids[x:y].tolist() == encoded(t)[:-1], repr(t)
        odd = odd[:1500] if size == 1 else odd


@pytest.mark.parametrize("window", [64, 1000])
def test_packing(docs, rows, empty, window):
    from situ.llm.packing import pack

    from situ.llm.packing import sequences

    packed = pack(docs, window)
    got = packed.collect()
    used = {}
    for p in got:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(used) == list(range(len(used)))
    for s, pieces in used.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == window or s == len(used) - 1
    by = {}
    for p in got:
        by.setdefault(p.doc_id, []).append(p)
    for i, t, *_ in rows:
        if i == 3:
            continue
        ids = encoded(t)
        pieces = sorted(by[i], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length] and p.doc_tokens == len(ids)
    made = {q.sequence_id: q for q in sequences(packed).collect()}
    assert sorted(made) == sorted(used)
    for p in got:
        q = made[p.sequence_id]
        assert q.ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids and q.n_tokens == len(q.ids) // 4 <= window
        assert (p.offset, p.length, p.doc_id, p.start) in [tuple(b) for b in q.boundaries] and [b.offset for b in q.boundaries] == sorted(b.offset for b in q.boundaries)
    assert pack(empty).count() == 0 and sequences(pack(empty)).count() == 0


def test_packing_follows_files(spark, docs, tmp_path):
    from situ.llm.packing import pack

    docs.where("doc_id is not null and doc_id <> 3").repartitionByRange(4, docs.doc_id.desc()).sortWithinPartitions(docs.doc_id.desc()).write.parquet(str(tmp_path / "t"))
    got = pack(spark.read.parquet(str(tmp_path / "t")), 100, file_order=True).collect()
    order = [p.doc_id for p in sorted(got, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order, reverse=True)


def test_token_files(docs, rows, empty, monkeypatch):
    from pyspark.sql import functions as F

    from situ.llm import wavelet

    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    files = wavelet.token_files(docs)
    got = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(files).collect())
    hashes = {r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    at, want, every = 0, [], []
    for i, t, *_ in sorted(rows, key=lambda r: (key(r[0]), hashes[r[1] or ""])):
        ids = encoded(t)
        want.append((at, str(i), len(ids), crc(ids)))
        every += [(i, o, x) for o, x in enumerate(ids)]
        at += len(ids)
    assert got == want
    # Questions to the compressed files against the whole sequence.
    common = max({x for *_, x in every}, key=[x for *_, x in every].count)
    assert dict(map(tuple, wavelet.count_tokens(files, [0, common, 49_999_999]).collect())) == {0: len(rows), common: [x for *_, x in every].count(common), 49_999_999: 0}
    assert sorted((str(r.doc_id), r.offset, r.place) for r in wavelet.find_token(files, common).collect()) == sorted((str(i), o, p) for p, (i, o, x) in enumerate(every) if x == common)
    places = [0, 7, at - 1, at + 5, *random.Random(1).sample(range(at), 50)]
    assert sorted(map(tuple, wavelet.tokens_at(files, places).collect())) == sorted((p, every[p][2]) for p in set(places) if p < at)
    assert wavelet.read_documents(wavelet.token_files(empty)).count() == 0 and wavelet.find_token(wavelet.token_files(empty), 3).count() == 0


def test_token_files_share_out_rows_without_ids(spark):
    from situ.llm import wavelet

    rows = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same text' AS text")
    sizes = [r[0] for r in wavelet.token_files(rows, partitions=4).groupBy("part").sum("n_tokens").select("sum(n_tokens)").collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("size,top", [(0, 1), (1, 1), (700, 1), (3000, 9), (5000, 60000), (2000, 1 << 22)])
def test_wavelet_matrix(size, top):
    from situ.llm.wavelet import WaveletMatrix, read_shard, write_shard

    r = np.random.default_rng(size)
    values = r.integers(0, top, size).astype(np.uint32)
    ids, sizes, m = read_shard(write_shard([7], np.array([size]), values))
    assert (m.values() == values).all() and ids.tolist() == [7] and sizes.tolist() == [size]
    for i in r.integers(0, max(1, size), 40).tolist()[: 40 if size else 0]:
        v = int(values[i])
        assert m.access(i) == v and m.rank(v, i) == int((values[:i] == v).sum()) and m.count(v) == int((values == v).sum())
        places = np.flatnonzero(values == v)
        k = int(r.integers(0, len(places)))
        assert m.select(v, k) == places[k]
    assert m.count(top + 5) == 0 and isinstance(m, WaveletMatrix)
    if size == 5000:  # a question opens the chunks that it touches only
        long = read_shard(write_shard([7], np.array([1 << 20]), r.integers(0, top, 1 << 20).astype(np.uint32)))[2]
        long.access(12345)
        assert all(len(p.open) == 1 and len(p.chunks) == 8 for p in long.planes)


def brute_similar(rows, least=0.8):
    """The smallest id, as text, of each group that similarities of five-word shingles link."""
    sets = []
    for i, t, *_ in rows:
        words = [w for w in _split((t or "").translate(LOWER)) if w]
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or a | b and len(a & b) / len(a | b) >= least:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {str(find(i)) for i, _ in sets}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from situ.llm.quality import add_score, train

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near dedup", "mix sources", "packing"]
    table = [(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(texts(80, 9))] + [(100 + i, "BAD!! " * (9 + i), "en", "src1", 0) for i in range(20)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in table], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in add_score(docs, train(docs, labels)).collect()}
    left = [r for r in table if scores[r[0]] >= 0.3]
    best = {}
    for r in left:
        k = "".join(c for c in r[1] or "" if c not in WHITE)
        best[k] = min(best.get(k, (1, 0)), (-len(r[1] or ""), r[0]))
    left = [r for r in left if r[0] in {b[1] for b in best.values()}]
    stay = brute_similar(left)
    assert {str(p.doc_id) for p in got} == stay and not any(p.doc_id >= 100 for p in got)
    total = sum(len(encoded(r[1])) for r in left if str(r[0]) in stay)
    assert sum(p.length for p in got) == total and len({p.sequence_id for p in got}) == math.ceil(total / 1024)
    # The packing follows the mixture: in it the first documents come from all sources.
    order = [p.doc_id for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    source = {r[0]: r[3] for r in table}
    runs = [a for a, b in zip([source[i] for i in order], [None, *[source[i] for i in order]]) if a != b]
    assert len(set(runs)) == 4


def test_registered(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    assert {"op2_line_dedup", "op5_url_filter", "op7_exact_dedup"} <= set(e.oracle_sql())
