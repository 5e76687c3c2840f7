"""Cases where operators once did less than the whole job."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return [f"{r.choice('bcdfgh')}{r.randint(0, 4000)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in rows], SCHEMA).repartition(3)


def test_near_dedup_with_missing_and_reused_ids(spark):
    from situ.llm.simhash import near_deduplicate, near_groups

    r = random.Random(7)
    a, b, c, d, e = (" ".join(prose(r, 50)) for _ in range(5))
    # A row without an id equals one with an id; others without an id, and id 5 with two texts, are unrelated to it.
    docs = table(spark, [(1, a), (None, a.upper()), (None, b), (None, c), (None, c.upper()), (5, d), (5, e), (4, d.upper())])
    got = {(x.doc_id, x.component_id) for x in near_groups(docs).collect()}
    assert got == {(1, 1), (None, 1), (None, None), (5, 4), (4, 4), (5, 5)}
    left = sorted((str(x.doc_id), x.text.lower()) for x in near_deduplicate(docs).collect())
    assert left == sorted([("1", a), ("None", b), ("None", c), ("4", d), ("5", e)])


def shingles(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    r, rows, want = random.Random(11), [], set()
    for i in range(60):
        words = prose(r, r.randint(60, 200))
        edited = list(words)
        for k in range(r.randint(1, 8)):
            edited[r.randrange(len(words))] = f"new{k}"
        a, b = shingles(" ".join(words)), shingles(" ".join(edited))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
        want |= {2 * i} if len(a & b) / len(a | b) >= 0.8 else {2 * i, 2 * i + 1}
    assert 70 < len(want) < 110
    out = corpus_pipeline.simhash_near_dedup(spark, table(spark, [*rows, (None, rows[0][1].upper()), (None, ""), (None, None)]), "")
    got = [x.doc_id for x in out.collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1


def test_similar_links_find_what_brute_force_finds():
    import numpy as np

    from situ.llm.simhash import similar_links

    r = random.Random(3)
    base = [r.sample(range(1000), 40) for _ in range(4)]
    sets = [(i, np.unique(np.array(r.sample(base[i % 4], r.randint(25, 40)) + r.sample(range(1000), r.randint(0, 4)), np.uint64))) for i in range(80)]

    def groups(links):
        top = {i: {i} for i, _ in sets}
        for a, b in links:
            if top[a] is not top[b]:
                top[a] |= top[b]
                for x in top[b]:
                    top[x] = top[a]
        return {frozenset(g) for g in top.values()}

    every = [(i, j) for i, a in sets for j, b in sets if i < j and len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()}) >= 0.8]
    assert groups(similar_links(sets, 0.8)) == groups(every) and 4 < len(groups(every)) < 80


def test_pseudonyms_of_values_beside_other_numbers():
    from situ.llm.pii import pseudonymise

    for value in ("4111 1111 1111 1111", "212-555-0100", "123-45-6789"):
        alone = pseudonymise(value, b"k")[0]
        assert alone != value
        for text in ("room 24 {}", "item 55 {}", "{} 12", "7 {} 24", "{} {}", "12 37 {}, 56"):
            got, counts = pseudonymise(text.replace("{}", value), b"k")
            assert got == text.replace("{}", alone) and sum(counts.values()) == text.count("{}"), (text, value, got)
    assert pseudonymise("order 12 4111 1111 1111 1111", b"k")[0] == "order 12 " + pseudonymise("4111 1111 1111 1111", b"k")[0]
    for s in ("order 12 4111 1111 1111 1112", "55 666-45-6789", "version 1.2.3", "12 34 56"):
        assert pseudonymise(s, b"k") == (s, {})
