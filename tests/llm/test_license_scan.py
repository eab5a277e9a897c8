import os
import random
import re
import tempfile

from odd import ROWS, odd_docs, table, text_of
from pyspark.sql import functions as F

from loanlens.llm import license_scan

WORD = re.compile(r"[^\W_]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def contained(text, template):
    """The share of the template's shingles: for each of its parts the largest
    number in any run of the text of the length its class reads at once."""
    own, wanted = shingles(text), list(dict.fromkeys(shingles(template)))
    width = -(-len(wanted) // -(-len(wanted) // license_scan.LONGEST))
    total = 0
    for lo in range(0, len(wanted), width):
        part = set(wanted[lo:lo + width])
        step = 2 << (len(part).bit_length() - 1)
        total += max((len(part & set(own[i:i + 2 * step])) for i in range(0, max(1, len(own)), step)), default=0)
    return total / len(wanted)


def brute(rows, templates):
    out = {}
    for i, text in rows:
        names = {n for n, t in templates if shingles(t) and contained(text, t) >= license_scan.CONTAINMENT}
        out[i] = ",".join(sorted(names))
    return out


def test_band_settings():
    assert license_scan.collision_probability(1 / 4) > 0.999
    assert license_scan.collision_probability(0.8 / 4.2) > 0.99


def test_agreement_of_bands_is_as_good_as_independent_ones(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        common = [rng.getrandbits(63) for _ in range(8)]
        rows.append((i, common + [rng.getrandbits(63) for _ in range(24)], common))      # Jaccard 1/4
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    pairs = F.zip_with(license_scan._bands(F.col("a"), 32), license_scan._bands(F.col("b"), 32), lambda x, y: x == y)
    hit = df.select(F.exists(pairs, lambda x: x).alias("hit")).where("hit").count()
    assert hit / 400 >= 0.99


def planted(n, seed=3):
    rng = random.Random(seed)
    rows, short = [], [(n, t) for n, t in license_scan.TEMPLATES if len(shingles(t)) <= license_scan.LONGEST]
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 120))]
        for name, t in rng.sample(short, rng.randint(0, 2)):
            own = t.split()
            if rng.random() < 0.4 and len(own) > 12:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        rows.append((i, " ".join(words), "en", "a"))
    return rows


def test_matches_against_brute_force(spark):
    rows = planted(150)
    docs = odd_docs(spark, rows)
    got = {r.doc_id: r.licenses for r in license_scan.licenses(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], license_scan.TEMPLATES)
    assert sum(bool(x) for x in got.values()) > 40
    # template tables beyond the broadcast bound: the same matches
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(license_scan.scan(docs)) == key(license_scan.scan(docs, broadcast_rows=0))


def test_texts_of_many_parts_are_found_in_altered_form(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        name, t = license_scan.TEMPLATES[rng.randrange(len(license_scan.TEMPLATES))]
        own = t.split()
        for _ in range(len(own) // 60):                       # a word in sixty: a shingle in twelve
            own[rng.randrange(len(own))] = "changed"
        around = [f"w{rng.randrange(500)}" for _ in range(200)]
        rows.append((i, " ".join(around[:rng.randrange(200)] + own + around), "en", "a"))
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in
           license_scan.licenses(odd_docs(spark, rows)).collect()}
    wanted = {i: set(filter(None, x.split(","))) for i, x in
              brute([(r[0], r[1]) for r in rows], license_scan.TEMPLATES).items()}
    assert all(got[i] <= wanted[i] for i in wanted)
    links = sum(map(len, wanted.values()))
    assert links > 100 and sum(map(len, got.values())) / links >= 0.99


def test_100_000_template_shingles(spark):
    """A long list of templates of several parts, from files, joined by broadcast and by shuffle."""
    rng = random.Random(4)
    listed = [(f"L{i:03d}", " ".join(f"t{rng.randrange(3000)}" for _ in range(1004))) for i in range(100)]
    folder = tempfile.mkdtemp(prefix="templates-")
    for name, text in listed:
        with open(os.path.join(folder, f"{name}.txt"), "w") as f:
            f.write(text)
    templates = license_scan.read_templates(spark, folder)
    size = license_scan.template_parts(spark, templates).agg(F.sum(F.size("shingles"))).first()[0]
    assert size > 99_000
    rows = [(i, "before it " + text + " and after", "en", "a") for i, (_, text) in enumerate(listed[::10])]
    rows += [(100 + i, " ".join(text.split()[:600]), "en", "a") for i, (_, text) in enumerate(listed[::10])]
    docs = odd_docs(spark, rows)
    for most in (license_scan.BROADCAST_ROWS, 0):
        got = {r.doc_id: r.licenses for r in
               license_scan.licenses(docs, templates=templates, broadcast_rows=most).collect()}
        assert got == {r[0]: listed[r[0] * 10][0] if r[0] < 100 else "" for r in rows}


def test_a_window_and_a_part_are_verified_once_and_native(spark):
    plan = license_scan.licenses(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_long_templates_are_read_in_parts(spark):
    long = " ".join(f"term{i}" for i in range(200))
    half = " ".join(f"term{i}" for i in range(100))
    rows = [(1, "before " + long + " after", "en", "a"), (2, half, "en", "a"), (3, "none of it", "en", "a")]
    got = {r.doc_id: r for r in license_scan.licenses(odd_docs(spark, rows), templates=[("L", long)]).collect()}
    assert got[1].licenses == "L" and got[1].containment == 1.0
    assert got[2].n_licenses == got[3].n_licenses == 0


def test_given_and_odd_documents(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    got = {r.doc_id: r.licenses for r in license_scan.licenses(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], license_scan.TEMPLATES)
    odd = license_scan.licenses(odd_docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in odd) == sorted(str(r[0]) for r in ROWS)
    for r in odd:
        assert r.licenses == ("MIT" if r.doc_id == 5000000000 else "")
    assert not any(license_scan.licenses(odd_docs(spark), templates=[]).select("licenses").collect()[i][0]
                   for i in range(len(ROWS)))
    assert license_scan.licenses(odd_docs(spark, [])).collect() == []
    assert text_of(ROWS[3]) == ""
