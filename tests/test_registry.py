"""Registry search over own columns, related tables and tags."""

from lorespark.operators.registry import search_registry


def _tables(spark):
    rows = spark.createDataFrame(
        [(1, "Atlas", "Ann", None, True), (2, "Border", None, "Bo Ann", False), (3, None, None, None, None), (4, "Cat 100%", "Cy", "x", True)],
        "id long, title string, own_author string, source_author string, active boolean",
    )
    aliases = spark.createDataFrame([(2, "World ATLAS"), (2, "atlas of borders"), (3, None), (9, "atlas")], "id long, alias string")
    tags = spark.createDataFrame([(1, 7, "maps", "Maps"), (4, 8, "pets", "All Pets"), (4, 8, "pets", "All Pets"), (3, 8, None, None)], "id long, tag long, slug string, name string")
    return rows, aliases, tags


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_query_may_match_a_column_or_any_alias(spark):
    rows, aliases, _ = _tables(spark)
    found = search_registry(rows, "id", q=" atlas ", columns=["title"], related=[(aliases, ["alias"])])
    assert _ids(found) == [1, 2] and found.columns == rows.columns
    assert _ids(search_registry(rows, "id", q="  ", columns=["title"], related=[(aliases, ["alias"])])) == [1, 2, 3, 4]
    assert _ids(search_registry(rows, "id", q="%", columns=["title"])) == [4]
    assert _ids(search_registry(rows, "id", q="zzz", columns=["title"], related=[(aliases.limit(0), ["alias"])])) == []


def test_tags_by_id_slug_or_name(spark):
    rows, _, tags = _tables(spark)
    by = lambda tag: _ids(search_registry(rows, "id", tag=tag, tags=tags))
    assert by(8) == by("8") == [3, 4]
    assert by("PETS") == by(" all pets ") == [4]
    assert by("none") == []


def test_author_values_and_identities(spark):
    rows, _, _ = _tables(spark)
    authors = [(["own_author", "source_author"], "ann")]
    assert _ids(search_registry(rows, "id", contains=authors)) == [1, 2]
    assert _ids(search_registry(rows, "id", contains=authors, equals={"active": True})) == [1]
    assert _ids(search_registry(rows, "id", equals={"title": "ATLAS"})) == [1]
    assert _ids(search_registry(rows, "id", identities=[("id", ["title"], "border")])) == [2]
    assert _ids(search_registry(rows, "id", identities=[("id", ["title"], 4)])) == [4]
