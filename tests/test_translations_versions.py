from pyspark.sql import functions as F

from pulseyard.operators import translations, versions
from pulseyard.sources import readers

SHEET = 'STRING,en-US,de-DE,de-CH,fr-FR\nHELLO,Hello,Hallo,"Grüezi,\nhoi",\nBYE,Bye,Tschüss,Ade,Adieu\nHELLO,"Hi ""you""",Hallo!,Hoi,Salut\n'


def read(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(SHEET, encoding="utf-8")
    return readers.read_translations(spark, str(path))


def test_sets_from_csv(spark, tmp_path):
    sheet = read(spark, tmp_path)
    assert translations.sheet_languages(sheet) == ["en-US", "de-DE", "de-CH", "fr-FR"]
    sets = {}
    for r in translations.translation_sets(sheet).collect():
        sets.setdefault(r.language, {})[r.key] = r.text
    assert sets["en-US"] == {"HELLO": 'Hi "you"', "BYE": "Bye"}
    assert sets["de-CH"] == {"HELLO": "Hoi", "BYE": "Ade"}
    assert sets["fr-FR"]["HELLO"] == "Salut"


def test_empty_and_multiline_cells(spark, tmp_path):
    sheet = read(spark, tmp_path).filter("row = 0")
    texts = {r.language: r.text for r in translations.translation_sets(sheet).collect()}
    assert texts["fr-FR"] == "" and texts["de-CH"] == "Grüezi,\nhoi"


def python_resolve(tag, languages):
    if tag is None:
        return languages[0]
    exact = [x for x in languages if x == tag]
    similar = [x for x in languages if x.startswith(tag[:2])]
    return (exact or similar or ["en-US"])[0]


def test_resolve_language(spark, tmp_path):
    sheet = read(spark, tmp_path)
    languages = translations.sheet_languages(sheet)
    tags = ["de-CH", "de-AT", "xx", None, "fr", "f", "", "en-GB", "DE"]
    asked = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = asked.select("tag", translations.resolve_language(F.col("tag"), languages).alias("l")).collect()
    assert {r.tag: r.l for r in got} == {t: python_resolve(t, languages) for t in tags}
    maps = translations.translation_for_tag(asked, sheet).collect()
    assert {r.text for r in maps if r.tag == "de-AT" and r.key == "BYE"} == {"Tschüss"}
    assert {r.text for r in maps if r.tag is None and r.key == "BYE"} == {"Bye"}


def test_versions_from_files(spark, tmp_path):
    (tmp_path / "master.v0.json").write_text('{\n "current-version-stable": 1.0,\n "current-version-prerelease": 1.5\n}')
    (tmp_path / "master.v1.json").write_text('{"current-version-stable": "1.0.0.0", "current-version-prerelease": "2", "x": 1}')
    table = readers.read_versions(spark, str(tmp_path))
    assert {r.api_version: (r.current_version_stable, r.current_version_prerelease) for r in table.collect()} == {
        0: ("1", "1.5"), 1: ("1.0.0.0", "2"),
    }
    assert readers.read_version(spark, str(tmp_path)).first().current_version_prerelease == "1.5"
    updates = spark.createDataFrame(
        [(1, "3", None, True), (2, None, "4", True), (3, "5", None, True), (4, "9", "9", False), (5, None, None, True)],
        "seq bigint, current_version_stable string, current_version_prerelease string, authorised boolean",
    )
    updated = {r.api_version: tuple(r)[1:] for r in versions.apply_version_updates(table, updates).collect()}
    assert updated == {0: ("1", "1.5"), 1: ("5", "4")}
    untouched = versions.apply_version_updates(table, updates.filter("false")).filter("api_version = 1").first()
    assert untouched.current_version_stable == "1.0.0.0"
