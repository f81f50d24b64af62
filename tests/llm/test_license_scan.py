"""License scans against brute force over all windows."""

import random
import re

from factsieve.llm import license_scan
from factsieve.llm.queries import QUERIES

SMALL = {k: license_scan.NOTICES[k] for k in ("MIT-notice", "Apache-2.0-notice", "GPL-3-notice", "Apache-2.0-header", "MIT", "ISC")}


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def in_windows(text, template, share):
    n, step = len(template), -(-len(template) // 2)
    least = -(-round(share * n * 1000) // 1000)
    return max([common(text[i:i + n + step], template) for i in range(0, len(text), step)] + [0]) >= least


def test_license_scan_against_brute_force(spark):
    rng = random.Random(9)
    prose = lambda n: [rng.choice(["the", "of", "and", "under", "license", "a", "copy", "é", "is", "Xy."] + [f"w{rng.randint(0, 99)}"] * 4) for _ in range(n)]
    rows, planted = [], []
    for i in range(60):
        words, put = prose(rng.randint(0, 300)), []
        for name in rng.sample(sorted(SMALL), rng.randint(0, 2)):
            copy = SMALL[name].split()
            for _ in range(rng.choice([0, 0, 1, 3]) * len(copy) // 60):  # a few words changed, fewer than a tenth
                copy[rng.randrange(len(copy))] = "changed"
            words += copy + prose(rng.randint(0, 200))
            put.append(name)
        rows.append((i, " ".join(words)))
        planted.append(put)
    rows += [(60, None), (61, ""), (62, " \n"), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.selectExpr("*", "'clash' AS license")
    out = license_scan.scan(df, texts=SMALL).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, license_scan.scan(df.repartition(5), texts=SMALL).collect()))
    texts = dict(rows)
    for r in out:
        text = tokens(texts[r.doc_id])
        finds = [f.split(":") for f in r.found.split(",") if f]
        want = {n for n, t in SMALL.items() if in_windows(text, tokens(t), 0.9)}
        assert {f[0] for f in finds} == want and r.n_found == len(finds)
        if r.doc_id is not None and r.doc_id < 60:
            assert set(planted[r.doc_id]) <= want
        for name, n, first, last in finds:
            assert int(n) <= common(text[int(first):int(last) + 1], tokens(SMALL[name]))
        assert (r.license is None) == (not want) and (r.coverage >= 0.9) == bool(want)
    assert license_scan.scan(df.where("1 = 0"), texts=SMALL).count() == 0


def test_every_copy_and_every_template_is_found(spark):
    notice, whole = license_scan.NOTICES["MIT-notice"], license_scan.templates()
    rows = [(1, " ".join([notice] * 7)), (2, notice.upper() + " x" * 50_000 + "\n" + notice)]
    rows += [(10 + i, "before it " + whole[n] + " after it") for i, n in enumerate(sorted(whole))]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].n_found == 7 and out[2].found == "MIT-notice:5:0:4,MIT-notice:5:50005:50009"
    for i, n in enumerate(sorted(whole)):
        assert out[10 + i].license == n and out[10 + i].coverage == 1.0
    assert [k for k in QUERIES if k.startswith("op9_")] == ["op9_license_scan"]
