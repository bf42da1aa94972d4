"""Column functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbering, text, tokens, vectors


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **given):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first()["x"]

    return run


@pytest.mark.parametrize("roman,n", [("I", 1), ("iv", 4), ("IX", 9), ("XL", 40), ("XC", 90), ("CD", 400), ("MCMXCIV", 1994), ("", 0), ("IIII", 4), ("ABC", None)])
def test_roman_to_int(value, roman, n):
    assert value(numbering.roman_to_int(F.col("r")), r=roman) == n


@pytest.mark.parametrize("n,roman", [(1, "I"), (14, "XIV"), (1994, "MCMXCIV"), (3999, "MMMCMXCIX"), (0, None), (4000, None)])
def test_int_to_roman(value, n, roman):
    assert value(numbering.int_to_roman(F.col("n")), n=n) == roman


@pytest.mark.parametrize("letter,n", [("A", 1), ("z", 26), ("aa", None), ("1", None)])
def test_letters(value, letter, n):
    assert value(numbering.letter_to_int(F.col("c")), c=letter) == n


@pytest.mark.parametrize("label,kind", [("1.2.3", "decimal"), ("2.", "decimal"), ("IV", "roman_upper"), ("iv)", "roman_lower"), ("(b)", "letter_lower"), ("§ 4.1", "section_symbol"), ("B", "letter_upper"), ("foo", "mixed")])
def test_kind_of(value, label, kind):
    assert value(numbering.kind_of(F.col("t")), t=label) == kind


def test_normalise(value):
    assert value(numbering.normalise(F.lit("decimal"), F.col("t")), t="1.2.3.") == [1, 2, 3]
    assert value(numbering.normalise(F.lit("section_symbol"), F.col("t")), t="§ 4.1") == [4, 1]
    assert value(numbering.normalise(F.lit("roman_lower"), F.col("t")), t="xiv") == [14]
    assert value(numbering.normalise(F.lit("mixed"), F.col("t")), t="?") == []


def test_clean_text(value):
    assert value(text.clean_text(F.col("t")), t="  a \t b \r\n\n\n\n c\0�d\n") == "a b\n\ncd"
    assert value(text.clean_text(F.col("t")), t=" \n ") == ""


def test_snippet(value):
    assert value(text.snippet(F.col("t"), 10), t="short") == "short"
    assert value(text.snippet(F.col("t"), 10), t="aaaaaaaaa bbbbb") == "aaaaaaaaa..."
    assert value(text.snippet(F.col("t"), 10), t="aa bbbbbbbbbbbbbbb") == "aa bbbbbbb..."


def test_sentences(value):
    assert value(text.sentences(F.col("t")), t="Mr. Smith went. He left! Ok") == ["Mr.", "Smith went.", "He left!", "Ok"]


def test_sentences_keep_digits(value):
    assert value(text.sentences(F.col("t")), t="0 or 0. 1 or 1! 2 or 2? 192.168.1.3") == ["0 or 0.", "1 or 1!", "2 or 2?", "192.168.1.3"]
    assert value(text.sentences(F.col("t"), ends=text.SPACES), t="\xa0One. \u3000 Two.\xa0\xa0") == ["One.", "Two."]


def test_overlap_tail(value):
    assert value(text.overlap_tail(F.col("t"), 12), t="First one. Second part") == "Second part"
    assert value(text.overlap_tail(F.col("t"), 100), t="all") == "all"


def test_html(value):
    assert value(text.strip_tags(F.col("t")), t="<p>a<b>b</b></p><script>x()</script> c &amp; d<!-- e -->") == "a b c & d"
    assert value(text.strip_dangerous(F.col("t")), t="<p>a</p><script>x</script><IFRAME src=1>y</iframe><input>") == "<p>a</p>"


def test_map(value):
    given = F.create_map(F.lit(" A b"), F.lit(" x "), F.lit("a_b"), F.lit("y"), F.lit("c"), F.lit(" "), F.lit("d"), F.lit(None).cast("string"))
    assert value(text.clean_map(given)) == {"a_b": "y"}


def test_tokens(value):
    assert value(tokens.char_tokens(F.col("t")), t="abcdefgh9") == 2
    assert value(tokens.legal_tokens(F.col("t"), F.lit(10)), t="Section 4.2 of Roe v. Wade, pursuant to Acme Inc. rules") == 10 + 2 + 1 - 0
    assert value(tokens.valid_overlap(F.lit(100), F.lit(150))) == 25
    assert value(tokens.valid_overlap(F.lit(100), F.lit(-1))) == 0


def test_vectors(value):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert value(vectors.cosine(a, b)) == pytest.approx(0.96)
    assert value(vectors.unit(a)) == pytest.approx([0.6, 0.8])
    assert value(vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
