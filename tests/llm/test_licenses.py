"""License scans against containment in all windows."""

import math
import random
import re

import pytest

from vellum.llm import licenses


def norm(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = norm(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def plain(text, templates, least=0.8):
    """Templates whose shingles are contained in some window of twice the class width."""
    out = set()
    g = grams(text)
    for name, t in templates.items():
        own = set(grams(t))
        width = 8
        while width < len(own):
            width *= 4
        for at in range(0, max(1, len(g) - width), width):
            if len(own & set(g[at : at + 2 * width])) / len(own) >= least - 1e-12:
                out.add(name)
    return out


def test_scan(spark):
    fill = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor ".split()
    pad = lambda n, s: " ".join(fill[(i * s) % len(fill)] + str(i * s % 101) for i in range(n))
    texts = [None, "", "short", "MIT License"]
    for n in (0, 3, 8, 9, 40, 700):
        for t in licenses.TEMPLATES.values():
            texts.append(f"{pad(n, 3)} // {t} {pad(n // 2, 7)}")
            w = t.split()
            cut = w[: math.ceil(len(w) * 0.93)]
            texts.append(f"{pad(n, 5)}\n# {' '.join(cut)}\n# {pad(11, 2)}")
            texts.append(" ".join(w[: len(w) // 2]))
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[10], "x")] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"), every=True).collect()
    want = sorted({(str(i), name) for i, t, _ in rows for name in plain(t, licenses.TEMPLATES)})
    assert sorted({(str(r.doc_id), r.license) for r in got}) == want
    by = {i: t for i, t, _ in rows if i != 3}
    for r in got:
        if r.doc_id in by:  # the place itself holds what is claimed of it
            own = set(grams(licenses.TEMPLATES[r.license]))
            held = grams(by[r.doc_id].encode()[r.start : r.end].decode())
            assert held[0] in own and held[-1] in own and len(own & set(held)) / len(own) == pytest.approx(r.containment) and r.containment >= 0.8
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_copy_and_all_of_it(spark):
    """A grant that stands three times is found three times, from its first word to its last."""
    grant = licenses.TEMPLATES["MIT:grant"]
    text = f"One. {grant} Two.\n# {grant}\n{'filler words here ' * 300}{grant} End."
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), {"MIT": grant}).collect()
    assert sorted(text[r.start : r.end] for r in got) == [grant.rstrip(".")] * 3 and all(r.containment == 1 for r in got)


def test_recall_at_the_threshold(spark):
    """Templates with words replaced until just over 0.8 of the shingles are left."""
    rng, texts = random.Random(3), []
    for name, t in licenses.TEMPLATES.items():
        own, w = set(grams(t)), t.split()
        for _ in range(20 if len(own) > 10 else 2):
            cut = list(w)
            for i in rng.sample(range(len(w)), len(w)):
                trial = [*cut[:i], "zzz", *cut[i + 1 :]]
                if len(own & set(grams(" ".join(trial)))) / len(own) >= 0.8:
                    cut = trial
            texts.append((name, "words before it " * rng.randrange(60) + " ".join(cut) + " and words after it" * rng.randrange(60)))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(df, every=True).collect()}
    assert sum((i, name) in got for i, (name, _) in enumerate(texts)) >= 0.999 * len(texts)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.license) for r in licenses.op8_license_scan(spark, sf).collect()}
    want = {(r.doc_id, name) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for name in plain(r.text, licenses.TEMPLATES)}
    of = lambda pairs: {(i, name.split(":")[0]) for i, name in pairs}
    assert got <= want and of(got) == of(want) and len({name for _, name in of(got)}) >= 4


def test_one_row_for_a_license_in_a_place(spark):
    """A sentence that several templates of a license fit is told once, by the best; other licenses and places stay."""
    fill = " ".join(f"word{i}" for i in range(60))
    text = f"Licensed under the GNU Lesser General Public License, version 3. {fill} Released under the GNU Lesser General Public License, version 3. Licensed under CC BY 4.0."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted((r.start, r.license, r.containment) for r in licenses.scan(df).collect())
    assert [(name, share) for _, name, share in got] == [("LGPL-3.0:notice1", 1.0), ("LGPL-3.0:notice0", 1.0), ("CC-BY-4.0:short", 1.0)]
    assert licenses.scan(df, every=True).count() > 3
