import pytest

from tarnsearch.operators.query import parse


@pytest.mark.parametrize(
    ("text", "terms", "excluded", "phrases"),
    [
        ("motor de búsqueda", ["motor", "de", "busqueda"], [], []),
        ('perl "motor de busqueda" 2004', ["perl", "2004"], [], [["motor", "de", "busqueda"]]),
        ('"perl"', ["perl"], [], []),
        ("finder -other", ["finder"], ["other"], []),
        ("anchor-text", ["anchor", "text"], [], []),
        ("x -b-c", ["x"], ["b", "c"], []),
        ("- foo bar", ["bar"], ["foo"], []),
        ('-"a b" c', [], ["c"], [["a", "b"]]),
        ('perl "motor de', ["perl"], [], [["motor", "de"]]),
        ("b b a b", ["b", "a", "b"], [], []),
        ("", [], [], []),
        ('-only "" --', [], ["only"], []),
    ],
)
def test_parse(text, terms, excluded, phrases):
    q = parse(text)
    assert (q.terms, q.excluded, q.phrases) == (terms, excluded, phrases)


def test_empty_and_scoring_terms():
    assert parse("-only-negatives").is_empty and parse("  ").is_empty
    assert parse('perl "perl moderno"').scoring_terms() == ["moderno", "perl"]
