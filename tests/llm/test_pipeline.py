"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_simhash import plain as fingerprint
from tests.llm.test_simhash import roots
from tests.llm.test_suffixes import plain as cut

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here at all", "en", "a", 17), (4, "tie tie tie tie tie", "en", "b", 1), (4, "tie tie tie tie tie", "en", "b", 1), (5, "long words " * 3000, "en", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def passages_cut(body, spans):
    """The text without those of the spans that have more than 50 words, and the characters that they divide."""
    gone = set()
    for lo, hi in spans:
        if len(body[lo:hi].split()) > 50:
            gone.update(range(lo, hi))
    out, at = [], 0
    for char in body.decode():
        n = len(char.encode())
        if not gone.intersection(range(at, at + n)):
            out.append(char)
        at += n
    return "".join(out)


def test_passages_that_repeat_go(spark):
    """Runs of more than 50 words that two documents share are not found in what is left, and
    documents without such a run stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = cp.simhash_stage(spark, docs, SF).collect()
    after = {r.doc_id: r.text for r in cp.suffix_stage(spark, spark.createDataFrame(before, docs.schema), SF).collect()}
    runs, found = {}, set()
    for r in before:
        words = r.text.split()
        for i in range(len(words) - 50):
            run = " ".join(words[i : i + 51])
            if runs.setdefault(run, r.doc_id) != r.doc_id:
                found.add(run)
    left = hit = 0
    for r in before:
        own = {" ".join(w[i : i + 51]) for w in [r.text.split()] for i in range(len(w) - 50)} & found
        words = after.get(r.doc_id, "").split()
        now = {" ".join(words[i : i + 51]) for i in range(len(words) - 50)}
        hit, left = hit + len(own), left + len(own & now)
    assert hit > 1000 and left <= 0.01 * hit


def test_characters_of_the_source_stay(spark):
    """Replacement characters that a text has of its own are no trace of a cut."""
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{i}a\ufffdb\u00e9{passage}{chr(0xE0 + i)}\ufffdz{i}", "en", "a", 1) for i in range(3)]
    got = {r.doc_id: r.text for r in cp.suffix_stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert got == {i: f"{i}{chr(0xE0 + i)}\ufffdz{i}"[:1] + f"\ufffdz{i}" for i in range(3)}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = cp.quality_stage(spark, docs, SF)
    rows = good.collect()
    left = {r.doc_id for r in rows}
    assert all((i in left) == (q == 1) for i, q in labels.items())

    one = cp.simhash_stage(spark, good, SF)
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    values = set(prints.values())
    root = roots(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 4])
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    rows = one.collect()
    assert sorted(r.doc_id for r in rows) == sorted(least.values())

    short = cp.suffix_stage(spark, one, SF)
    want = {r.doc_id: passages_cut(r.text.encode(), spans) for r, (spans, _) in zip(rows, cut([r.text.encode() for r in rows], 150), strict=True)}
    got = {r.doc_id: r.text for r in short.collect()}
    assert got == {i: t for i, t in want.items() if t}

    mixed = cp.mixing_stage(spark, short, SF)
    words = Counter()
    for r in mixed.collect():
        n = len(r.text.split())
        assert 0 < n <= len(got[r.doc_id].split()) and (n < len(got[r.doc_id].split()) or r.text == got[r.doc_id])
        words[r.doc_id] += n
    assert all(n <= 3 * len(got[i].split()) for i, n in words.items())
    total = sum(len(t.split()) for t in got.values())
    assert abs(sum(words.values()) - total) <= 25

    assert all(r.intact for r in cp.bpe_stage(spark, mixed, SF).collect())


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.count() > 50 and out.filter("not intact").count() == 0


def test_odd_rows(spark):
    docs = odd(spark)
    for _, stage in cp.STAGES:
        for one in (docs, docs.limit(0)):
            stage(spark, one, SF).count()


def test_one_row_of_each_group(spark):
    """Null and repeated ids: every group of near-duplicates keeps one row, that of the least id."""
    text = lambda n: " ".join(f"{n}word{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("c")), (5, text("c")), (9, text("d")), (9, text("e")), (9, text("e")), (8, text("e")), (None, text("e"))]
    prints = {fingerprint(t) for _, t in rows}
    assert len(prints) == 5 and all((x ^ y).bit_count() > 4 for x in prints for y in prints if x != y)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((r.text[:1], r.doc_id) for r in cp.simhash_stage(spark, docs, SF).collect())
    assert got == [("a", None), ("b", None), ("c", 5), ("d", 9), ("e", 8)]


def test_planted_passages_go_and_clean_documents_stay(spark):
    """Passages of 51 to 60 words, of short words too, that documents share at any place; documents without one are left alone."""
    import random

    rng = random.Random(21)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    prose = lambda n, a=2, b=9: " ".join(word(a, b) for _ in range(n))
    passages = [prose(51 + i % 10, *((2, 3) if i % 5 == 0 else (2, 9))) for i in range(25)]
    rows, own = [], {}
    for i, p in enumerate(passages):
        for k in range(2 + i % 3):
            head, tail = prose(rng.randint(0, 90)), prose(rng.randint(1, 90))
            own[100 * i + k] = (p, head, tail)
            rows.append((100 * i + k, f"{head} {p} {tail}".strip(), "en", "a", 1))
    clean = [(10_000 + i, prose(rng.randint(1, 300)), "en", "a", 1) for i in range(60)]
    near = passages[0].split()[:50]  # fifty words are no passage
    clean += [(20_000 + i, f"{prose(20)} {' '.join(near)} {prose(20)}", "en", "a", 1) for i in range(2)]
    docs = spark.createDataFrame(rows + clean, SCHEMA)
    got = {r.doc_id: r.text for r in cp.suffix_stage(spark, docs, SF).collect()}
    for i, (p, head, tail) in own.items():
        left = got[i].split()
        held = {" ".join(left[k : k + 51]) for k in range(len(left) - 50)}
        words = p.split()
        assert not held & {" ".join(words[k : k + 51]) for k in range(len(words) - 50)}, i
        assert " ".join(head.split()[:-2]) in got[i] and " ".join(tail.split()[2:]) in got[i]
    assert all(got[i] == t for i, t, *_ in clean)


def test_near_copies_that_four_bits_find(spark):
    """Copies of texts of 400 words with one word in 200 replaced: what share of them the stage takes out."""
    import random

    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(400)]
        copy = list(words)
        for at in rng.sample(range(400), 2):
            copy[at] = word()
        rows += [(2 * i, " ".join(words), "en", "a", 1), (2 * i + 1, " ".join(copy), "en", "a", 1)]
    left = {r.doc_id for r in cp.simhash_stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    found = sum(2 * i + 1 not in left for i in range(60)) / 60
    print("near copies taken out", found)
    assert all(2 * i in left for i in range(60)) and found > 0.5
