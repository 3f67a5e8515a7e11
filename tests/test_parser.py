import pytest

from lexispark import Clause, Presence, Query, QueryParseError, Wildcard, parse_query

FIELDS = ("title", "text")
EN = " \t\n\r\x0c\x0b\xa0-"
PLAIN = " \t\n\r\x0c\x0b\xa0"


def only(query, separators=EN):
    clauses = parse_query(query, FIELDS, separators).clauses
    assert len(clauses) == 1
    return clauses[0]


def test_modifiers_in_any_order_last_wins():
    for q in ("foo^3~2", "foo~2^3", "foo^9~2^3", "foo ~2 ^3"):
        c = only(q)
        assert (c.term, c.boost, c.edit_distance) == ("foo", 3.0, 2)


def test_presence_and_fields():
    got = [(c.presence, c.term, c.fields) for c in parse_query("+foo -title:bar baz", FIELDS, EN).clauses]
    assert got == [(Presence.REQUIRED, "foo", FIELDS), (Presence.PROHIBITED, "bar", ("title",)), (Presence.OPTIONAL, "baz", FIELDS)]
    assert only("- a").presence is Presence.PROHIBITED
    assert only("+ a").presence is Presence.REQUIRED


def test_case_wildcards_escapes_and_zero_boost():
    assert only("FOO").term == "foo"
    assert not only("foo*").use_pipeline
    assert only(r"a\:b").term == "a:b"
    assert not only(r"a\*b").use_pipeline
    assert only("foo^0").boost == 1.0


def test_hyphen_parts_terms_in_english_only():
    assert [c.term for c in parse_query("foo-bar", FIELDS, EN).clauses] == ["foo", "bar"]
    assert only("foo-bar", PLAIN).term == "foo-bar"
    assert [c.term for c in parse_query("foo^2.5", FIELDS, EN).clauses] == ["foo", ".5"]


@pytest.mark.parametrize(
    "query, said, span",
    [
        ("++a", "expecting term or field, found Presence", (1, 2)),
        ("+", "expecting term or field, found nothing", (0, 1)),
        ("a +", "expecting term or field, found nothing", (2, 3)),
        ("~1", "expected either a field or a term, found EditDistance", (1, 2)),
        ("a~", "edit distance must be numeric", (2, 2)),
        ("a^x", "boost must be numeric", (2, 2)),
        ("title:", "expecting term, found nothing", (0, 5)),
        ("title:+a", "expecting term, found Presence", (6, 7)),
        ("other:x", "unrecognised field 'other', possible fields: 'title', 'text'", (0, 5)),
    ],
)
def test_errors(query, said, span):
    with pytest.raises(QueryParseError) as e:
        parse_query(query, FIELDS, EN)
    assert (e.value.message, (e.value.start, e.value.end)) == (said, span)
    assert str(e.value) == f"query parse error at {span[0]}-{span[1]}: {said}"


def test_trailing_backslash_is_an_error():
    with pytest.raises(QueryParseError):
        parse_query("a\\", FIELDS, EN)


def test_programs_make_queries():
    q = Query(FIELDS).clause(Clause("a", wildcard=Wildcard.BOTH)).clause(Clause("*b", wildcard=Wildcard.LEADING)).term("c")
    assert [c.term for c in q.clauses] == ["*a*", "*b", "c"]
    assert [c.use_pipeline for c in q.clauses] == [False, False, True]
    assert not q.is_negated and not Query(FIELDS).is_negated
    assert Query(FIELDS).clause(Clause("x", presence=Presence.PROHIBITED)).is_negated
    with pytest.raises(ValueError):
        Query(FIELDS).clause(Clause("x", fields=("none",)))
