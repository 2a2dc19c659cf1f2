from quirespark.operators import folios


def table(spark, numbers, book="b"):
    rows = [(book, i, n, "", n is not None) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "book_id string, page_index long, number int, text string, confident boolean")


def kinds(spark, numbers):
    return sorted((r.kind, r.page_a, r.page_b, r.number) for r in folios.audit_folios(table(spark, numbers)).collect())


def test_ascending_is_clean_and_single_misreads_are_left_out(spark):
    assert kinds(spark, [1, 2, 3, 4]) == []
    assert kinds(spark, [1, 2, 77, 4, 5]) == [("misread", 2, None, 77)]


def test_inversion_gap_and_duplicate(spark):
    assert ("inversion", 1, 2, 2) in kinds(spark, [1, 3, 2, 4])
    assert kinds(spark, [10, 14, 15]) == [("gap", 0, 1, 10)]
    assert ("duplicate", 1, 2, 5) in kinds(spark, [4, 5, 5, 6])
    assert [list(r.missing) for r in folios.audit_folios(table(spark, [10, 14])).collect()] == [[11, 12, 13]]


def test_a_step_into_another_thousand_is_no_gap(spark):
    assert kinds(spark, [1026, 1027, 2001, 2002]) == []


def test_furniture_prefers_bare_numbers_and_demotes_common_ones(spark):
    rows = [("b", 1, 0, "Chapter 7 - 61"), ("b", 1, 1, "- 62 -"), ("b", 2, 0, "nothing here"), *[("b", 10 + k, 0, "99") for k in range(6)]]
    got = {r.page_index: r for r in folios.folios_from_furniture(spark.createDataFrame(rows, "book_id string, page_index long, pos long, text string")).collect()}
    assert (got[1].number, got[1].confident, got[2].number, got[2].text, got[12].confident) == (62, True, None, "nothing here", False)


def test_gaps_are_filled_between_anchors_only(spark):
    pages = spark.createDataFrame([("b", i) for i in range(8)], "book_id string, page_index long")
    got = {r.page_index: (r.number, r.source) for r in folios.fill_folio_gaps(table(spark, [None, 5, None, 7, None, 20, None, None]), pages).collect()}
    assert got == {1: (5, "read"), 2: (6, "filled"), 3: (7, "read"), 5: (20, "read")}


def test_resolver_needs_both_neighbours_to_agree(spark):
    f = spark.createDataFrame([("b", 3, 10, "", True), ("b", 5, 12, "", True), ("b", 9, 20, "", True)], "book_id string, page_index long, number int, text string, confident boolean")
    w = spark.createDataFrame([("b", n) for n in (8, 10, 11, 15, 22)] + [("c", 1), ("b", None)], "book_id string, folio long")
    got = {(r.book_id, r.folio): r.page_index for r in folios.resolve_folios(w, f).collect()}
    assert got == {("b", 8): 1, ("b", 10): 3, ("b", 11): 4, ("b", 15): None, ("b", 22): 11, ("c", 1): None, ("b", None): None}
