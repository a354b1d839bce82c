from hypothesis import given, settings
from hypothesis import strategies as st

from tarnsearch.functions.text import FOLD_FROM, FOLD_TO, fold, host, py_query_terms, py_terms, query_terms, terms

TEXTS = ["Compañia Colombiana de Años", "a-b_c 42 ¡hola! ñandú", "ẞ and ß", "", " ,,, ", "ÑOÑO ÁRBOL", "x١٢y", "Ⅷ and ²", None, "ΟΔΟΣ"]


def test_spark_and_python_terms_agree(column):
    got = column(terms, TEXTS)
    assert got == [None if t is None else py_terms(t) for t in TEXTS]
    assert got[0] == ["compania", "colombiana", "de", "anos"]
    assert got[1] == ["a", "b", "c", "42", "hola", "nandu"]
    assert got[3] == got[4] == []


def test_every_folded_letter_becomes_one_plain_letter(column):
    assert len(FOLD_FROM) == len(FOLD_TO) == len(set(FOLD_FROM)) == 91
    assert column(fold, list(FOLD_FROM)) == list(FOLD_TO)
    assert column(fold, ["ß æ œ ŋ plain 123"]) == ["ß æ œ ŋ plain 123"]


def test_query_side_folds_before_it_splits(column):
    assert column(query_terms, ["İx"])[0] == py_query_terms("İx") == ["i", "x"]
    assert column(terms, ["İx"])[0] == py_terms("İx") == ["i̇x"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F)))
def test_terms_hold_no_separators(text):
    for t in py_terms(text):
        assert t and not any(c.isspace() for c in t)


def test_host(column):
    urls = ["HTTPS://User@Hub.Example.:8080/x?q#f", "http://a.b", "no url", "", None, "mailto:x@y"]
    assert column(host, urls) == ["hub.example", "a.b", None, None, None, None]
