from collections import defaultdict

from helpers import LONG, MEDIUM, awkward, awkward_rows, empty, read
from pyspark.sql import functions as F

from pulseyard.llm import exact_dedup, license_scan, quality_rules
from pulseyard.llm.license_scan import Template


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_dedup_awkward_rows(spark):
    got = exact_dedup.exact_dedup(awkward(spark)).collect()
    groups = defaultdict(list)
    for row in awkward_rows():
        groups[lower(row[1])].append(row[0])
    assert len(got) == len(awkward_rows())
    for r in got:
        ids = groups[lower(r["text"])]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = [lower(r["text"]) for r in got if r["kept"]]
    assert sorted(kept) == sorted(groups)
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_dedup_differs_after_the_prefix(spark):
    rows = [(i, LONG + tail) for i, tail in enumerate(["a", "b", "A", "bb"])]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3}


def test_hot_group(spark):
    rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("kept").count()
    assert got == 1001


def brute_base(text):
    words = text.split(None) if text else []
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_awkward_rows(spark):
    measured = quality_rules.measure(awkward(spark))
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()
    assert len(judged) == len(awkward_rows())
    for r in judged:
        assert tuple(r[c] for c in quality_rules.BASE) == brute_base(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    none = quality_rules.measure(empty(spark))
    assert quality_rules.judge(none, quality_rules.thresholds(none)).collect() == []


def test_repeated_windows_either_way(spark):
    few, many = "a b c x a b c y", " ".join(f"w{i % 60}" for i in range(300))
    rows = spark.createDataFrame([(few,), (many,), ("a a a a a",)], "text string")
    got = [r["n_repeat_words"] for r in quality_rules.measure(rows).collect()]
    assert got == [brute_base(t)[4] for t in (few, many, "a a a a a")]


def test_sketch_bucket(spark):
    values = [0, 1, 63, 64, 65, 100, 127, 128, 1000, 10**12 + 17]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for r in rows.select("v", quality_rules.sketch_bucket(rows.v).alias("b")).collect():
        assert r["b"] <= r["v"] and (r["v"] - r["b"]) * 32 <= r["v"]


def test_thresholds_follow_the_source(spark):
    """Code is full of symbols: a cut-off that fits prose would drop it, one from its own source keeps it."""
    prose = [(i, " ".join(f"word{(i * j) % 997}" for j in range(1, 90)), "en", "prose") for i in range(1, 81)]
    code = [(1000 + i, " ".join(f"a{(i * j) % 991}<b>&" for j in range(1, 90)), "en", "code") for i in range(1, 81)]
    odd = [(5000, " ".join(f"word{j}<b>&" for j in range(90)), "en", "prose")]
    measured = quality_rules.measure(spark.createDataFrame(prose + code + odd, "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()}
    assert not got.pop(5000) and all(got.values())


def test_limits_come_from_the_rows(spark):
    """Twice the symbols in every row of a source double its limit, nothing else; a few rows far out move none."""

    def source(name, symbols, rows=80, first=0):
        return [(first + i, " ".join(["word"] * (100 - i % 5) + [f"w{i}x{j}" + "#" * symbols for j in range(100)]), "en", name) for i in range(rows)]

    def limits(rows):
        measured = quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        return {r["source"]: r for r in quality_rules.thresholds(measured.withColumn("n_repeat_words", F.lit(0))).collect()}

    got = limits(source("a", 1) + source("b", 2) + source("few", 9, 10))
    assert got["a"]["symbols_high"] < got["b"]["symbols_high"] <= 2 * got["a"]["symbols_high"]
    assert got["few"]["symbols_high"] != got["a"]["symbols_high"]  # the sketch of the language
    assert got["a"]["symbols_low"] is None and 0 < got["a"]["word_length_low"] < got["a"]["word_length_high"]
    assert limits(source("a", 1) + source("a", 50, 8, 1000))["a"]["symbols_high"] == got["a"]["symbols_high"]


def test_short_texts_have_more_room(spark):
    """One and the same rate is beyond the limit in a long text and within the noise of a short one."""
    plain = [(i, " ".join(f"word{(i * j) % 997}" for j in range(1, 90)), "en", "a") for i in range(1, 81)]
    texts = [(1000 + n, " ".join(f"w{j}" + "#" * (j % 25 == 0) + "x" * 4 for j in range(n)), "en", "a") for n in (60, 3000)]
    measured = quality_rules.measure(spark.createDataFrame(plain + texts, "doc_id long, text string, lang string, source string"))
    got = {r["doc_id"]: r["failed_rules"] for r in quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()}
    assert "symbols" not in got[1060] and "symbols" in got[4000] and not any(got[i] for i in range(1, 81))


def test_quality_agrees_with_labels(spark):
    docs = read(spark, "documents", MEDIUM)
    measured = quality_rules.measure(docs)
    judged = quality_rules.judge(measured, quality_rules.thresholds(measured)).filter("not base_failed")
    rows = judged.join(read(spark, "labels", MEDIUM), "doc_id").select("kept", "quality").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 10


def test_quality_clashing_names(spark):
    names = "__limit_lang limit _limit rate bucket n_lines below total q1 q3 symbols_high word_hashes window_hashes repeated_hashes hash_places".split()
    docs = awkward(spark).select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)], F.create_map(F.lit("k"), F.lit(1)).alias("a.bag"))
    measured = quality_rules.measure(docs)
    got = quality_rules.judge(measured, quality_rules.thresholds(measured)).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        assert all(r[n] == f"x{i}" for i, n in enumerate(names) if n != "n_lines") and r["a.bag"] == {"k": 1}


def test_license_awkward_rows(spark):
    got = license_scan.license_scan(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in got)
    assert license_scan.license_scan(empty(spark)).collect() == []


def test_license_places(spark):
    text = "CC BY cc-by; the MIT License\nand gnu General public license x apache  license CC  BY"
    r = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.lower().replace("-", " ").replace(";", "").split()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), 6, 0, len(words) - 2)
    assert r["base_labels"] == "apache,cc-by,gpl,mit" and r["score"] == 1


def test_containment_join_is_exact(spark):
    """The filtered join finds the same pairs as comparing every block with every template."""
    import random

    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(30)]
    templates = [Template(f"l{k}", " ".join(rng.sample(vocab, rng.randint(2, 12)))) for k in range(8)]
    blocks = [(i, rng.sample(vocab + ["other", "words"], rng.randint(0, 25))) for i in range(400)]
    order = license_scan.token_order(
        spark.createDataFrame([(" ".join(t),) for _, t in blocks], "text string"), sorted({t for x in templates for t in x.text.split()})
    )
    got = license_scan.containment_join(spark.createDataFrame(blocks, "key int, tokens array<string>"), templates, order, 0.7)
    got = {(r["key"], r["template"]) for r in got.collect()}
    wanted = {(i, k) for i, b in blocks for k, t in enumerate(templates) if len(set(t.text.split()) & set(b)) >= 0.7 * len(set(t.text.split())) - 1e-9}
    assert got == wanted and wanted


def template_labels(spark, texts):
    """The labels of every text that do not come from a base phrase."""
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [set(r["labels"].split(",")) - set(r["base_labels"].split(",")) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_license_siblings(spark):
    """A notice gets the label of its own template, not that of a sibling which shares most of its tokens."""
    wanted = {
        "Licensed under the GNU General Public License, version 3.": {"gpl-3.0"},
        "Licensed under the GNU General Public License, version 2.": {"gpl-2.0"},
        "Licensed under the GNU General Public License, version 2, see section 3.": {"gpl-2.0"},
        "Licensed under the GNU General Public License, version 2 or version 3.": {"gpl-2.0", "gpl-3.0"},
        "Licensed under the GNU Lesser General Public License, version 3.": set(),
        "Licensed under CC BY-NC 4.0": {"cc-by-nc"},
        "Licensed under CC BY-SA 4.0": {"cc-by-sa"},
        "Licensed under CC BY-NC-SA 4.0": {"cc-by-nc"},
        "Released under the MIT license": set(),  # a base phrase says it
        "Released under the BSD license": set(),
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "Licensed under the Apache License, Version 1.0": set(),
        "Licensed under the Mozilla Public License, Version 2.0": set(),
    }
    assert dict(zip(wanted, template_labels(spark, wanted), strict=True)) == wanted
    bsd = license_scan.license_scan(spark.createDataFrame([(1, "Released under the BSD license")], "doc_id int, text string")).first()
    assert (bsd["labels"], bsd["score"]) == ("", 0)


def test_license_wrapped(spark):
    """Notices that are wrapped anywhere, with comment marks and text around them, keep their labels."""
    import textwrap

    filler = "lorem ipsum dolor sit amet " * 30
    texts, wanted = [], []
    for template in license_scan.TEMPLATES:
        for width in (16, 30, 76):
            for before in (0, 1, 20, 21, 22, 43, 44, 45, 66):
                words = filler.split()[:before] + template.text.split() + filler.split()
                texts.append("\n".join(f"# {line}" for line in textwrap.wrap(" ".join(words), width)))
                wanted.append(template.label)
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert wanted[r["doc_id"]] in r["labels"].split(",") and r["score"] == 1, texts[r["doc_id"]]
    grant = license_scan.TEMPLATES[6].text
    apart = spark.createDataFrame([(1, (filler * 3).join(grant.split(" free ")))], "doc_id int, text string")
    assert license_scan.license_scan(apart.selectExpr("doc_id", "replace(text, 'dolor', '\n') AS text")).first()["labels"] == ""


def test_license_order_and_denial(spark):
    """The words of a notice out of their order, or denied, are no notice; nor does the layout matter."""
    import random

    filler = "lorem ipsum dolor sit amet " * 40
    for template in license_scan.TEMPLATES:
        words = template.text.split()
        if len(words) < 7:
            continue
        shuffled = words[:]
        random.Random(3).shuffle(shuffled)
        scattered = [x for w in shuffled for x in (w, "lorem")]
        texts = [" ".join(scattered), " ".join(shuffled), filler + " ".join(scattered) + " " + filler]
        assert template_labels(spark, texts) == [set()] * 3, template.text
    denied = [
        "Permission is not hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "released under a license of our own, the one of mit is not used here",
        "This work is never licensed under a creative commons attribution 4.0 international license",
    ]
    assert template_labels(spark, denied) == [set()] * 3
    grant = license_scan.TEMPLATES[6].text
    assert template_labels(spark, [f"{filler} {grant} {filler}", f"{filler}\n{grant}\n{filler}"]) == [{"mit"}] * 2
