"""Text and date expressions against plain Python."""

import random
import unicodedata
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgate.functions import dates, messages, schema, text

def full_width(text):
    """The same text in wide forms."""
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in text)


def spellings(rng, y, m, d, time):
    """(text, normal text) of a known date in one of the ways in which it may be written; time is None or up to three numbers."""
    sep = rng.choice("-/.")
    shown = [f"{y:04d}", f"{m:0{rng.choice([1, 2])}d}", f"{d:0{rng.choice([1, 2])}d}"]
    text, normal = sep.join(shown), "-".join(shown)
    if time is not None:
        clock = [f"{t:0{rng.choice([1, 2])}d}" for t in time]
        if rng.random() < 0.3:
            text, normal = f"{text}-{':'.join(clock)}", f"{normal}-{':'.join(clock)}"
        else:
            gap, colon = rng.choice([" ", "  ", "\u00a0"]), rng.choice([":", ".", " :"])
            text, normal = text + gap + colon.join(clock), f"{normal} {':'.join(clock)}"
    text = rng.choice(["", " ", "　"]) + text + rng.choice(["", "\t"])
    return (full_width(text) if rng.random() < 0.3 else text), normal


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_date_edge_cases(spark):
    """Spellings with the day that they name; None for those that name none."""
    last, first = date(2024, 1, 31), date(2024, 1, 5)
    cases = {
        "2024-1-5": first, "2024/01/31": last, "2024.01.31": last, "2024.01.31 10.30": last, "2024-01-31-10:30": last, "2024-01-31-10:30:05": last,
        "２０２４－０１－３１": last, "２０２４／０１／３１　１０：３０": last, "2024-01-31 10:30 :05": last, "\u00a02024-01-31\u3000": last, "2024-⑫-31": date(2024, 12, 31),
        "2024-⒈5": first, "٢٠٢٤-01-31": last, "2024-01-2٣": date(2024, 1, 23), "2024-01-31 1 0:3 0": last, "𝟐𝟎𝟐𝟒-01-31": last, "2024-01-31\n10:30": last,
        "2024-02-29": date(2024, 2, 29), "2024/1/ 5": None, "2024-02-30": None, "24-01-01": None, "0000-01-01": None, "2024-01-31T10:30": None,
        "2024-01-31 10:30:60": None, "2024-01-31 24:00": None, "n/a": None, "": None, "  ": None, "\u3000": None, "٠٠٠٠-01-01": None,
        "２０２４－０２－３０": None, "2024-01-31-10.30": None, "2024": None, "2024-01": None, "12024-01-3": None, "+2024-01-1": None, "2023-02-29": None,
        "2024-01-01-": None, "2024-01-31 ：30": None,
    }
    cases.pop("2024/1/ 5")  # told by test_day_set_off_by_a_blank
    got = evaluate(spark, list(cases), dates.parse_date)
    assert dict(zip(cases, got)) == cases
    assert evaluate(spark, [None], dates.parse_date) == [None]


def test_day_set_off_by_a_blank(spark):
    assert evaluate(spark, ["2024-01- 5", "2024/1/ 5"], dates.parse_date) == [date(2024, 1, 5)] * 2


def test_known_dates_in_random_spellings(spark):
    rng = random.Random(7)
    texts, days, normals = [], [], []
    for _ in range(4000):
        day = date(1990, 1, 1) + timedelta(days=rng.randrange(15_000))
        time = rng.choice([None, (rng.randrange(24), rng.randrange(60)), (rng.randrange(24), rng.randrange(60), rng.randrange(60))])
        text, normal = spellings(rng, day.year, day.month, day.day, time)
        texts.append(text)
        days.append(day)
        normals.append(normal)
    assert evaluate(spark, texts, dates.parse_date) == days
    assert evaluate(spark, texts, dates.normalize_date_text) == normals


def test_parts_out_of_range_are_no_dates(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        wrong = rng.choice([(2024, 13, 1, None), (2024, 0, 3, None), (2023, 2, 29, None), (2024, 4, 31, None), (2024, 5, 0, None), (2024, 5, 6, (24, 0)), (2024, 5, 6, (3, 60)), (2024, 5, 6, (3, 4, 60))])
        texts.append(spellings(rng, *wrong)[0])
    assert evaluate(spark, texts, dates.parse_date) == [None] * len(texts)


def test_every_digit_in_a_date(spark):
    """Each decimal digit of any script, as the last digit of the year and of the day."""
    texts, days = [], []
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            n = unicodedata.digit(c)
            texts += [f"201{c}-11-21", f"2012-11-2{c}"]
            days += [date(2010 + n, 11, 21), date(2012, 11, 20 + n)]
    assert len(texts) > 1000
    assert evaluate(spark, texts, dates.parse_date) == days


def test_normalized_date_text(spark):
    pairs = {
        "2024.01.31 10.30": "2024-01-31 10:30", " 2024/1/5 ": "2024-1-5", "２０２４．１．５　１０．３０": "2024-1-5 10:30", "a b c": "a bc", "": "", "\t": "",
        "2024-01-31 10:30 :05": "2024-01-31 10:30:05", "x.y/z 1.2": "x-y-z 1:2",
    }
    assert evaluate(spark, list(pairs), dates.normalize_date_text) == list(pairs.values())


def test_whitespace_is_pythons():
    import re
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    cls = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", text.WHITESPACE_CLASS)
    assert all(re.fullmatch(cls, ch) for ch in text.WHITESPACE)


def test_dedup_key(spark):
    pairs = {
        "Ａcme": "Acme", "　Ａ　": "A", " a b ": "a b", "ａ１！～": "a1!~", "㈱ﾊ": "㈱ﾊ", "Ｘ　Ｙ": "X Y", "\u00a0k\t": "k", "x\u200b": "x\u200b", "𠮷": "𠮷", "-": "-", "　": "", "＃１": "#1",
    }
    assert evaluate(spark, list(pairs), text.dedup_key) == list(pairs.values())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=126), max_size=8), min_size=1, max_size=40))
def test_wide_and_padded_keys_are_the_plain_ones(spark, values):
    assert evaluate(spark, [f"　{full_width(v)} \t" for v in values], text.dedup_key) == values


def test_key_of_null_is_empty(spark):
    assert evaluate(spark, [None, "㈱Ａ", "a", "A"], text.dedup_key) == ["", "㈱A", "a", "A"]


def test_display_and_short_values(spark):
    values = [None, "", " \u3000", "x" * 60, "x" * 61, " a "]
    assert evaluate(spark, values, text.display_value) == ["（空）", "（空）", "（空）", "x" * 60, "x" * 60 + "…", " a "]
    assert evaluate(spark, values, text.short_value) == ["", "", " \u3000", "x" * 60, "x" * 60 + "…", " a "]
    assert evaluate(spark, ["𠮷" * 60, "𠮷" * 61], text.short_value) == ["𠮷" * 60, "𠮷" * 60 + "…"]


def test_lengths_count_code_points(spark):
    assert evaluate(spark, ["𠮷ab", "é"], lambda c: F.length(c)) == [3, 1]


def test_first_line(spark):
    pairs = {"\n  \r\n b \nc": " b ", "": None, "a\u2028b": "a", "\x0b\x1cz": "z", "one": "one", "\r\r": None, "x\x85y": "x", " \u3000\nq": "q"}
    assert evaluate(spark, list(pairs), text.first_line) == list(pairs.values())
    assert evaluate(spark, [None], text.first_line) == [None]


def test_clean_text_and_defaults(spark):
    assert evaluate(spark, [None, " \u3000", " a "], text.clean_text) == ["", "", "a"]
    assert evaluate(spark, [None, " ", " a "], lambda c: text.text_or(c, "—")) == ["—", "—", "a"]


def test_count_and_replace_literal(spark):
    assert evaluate(spark, ["aaaa", "a.b", None, ""], lambda c: text.count_literal(c, "aa")) == [2, 0, 0, 0]
    assert evaluate(spark, ["a.b", "axb"], lambda c: text.replace_literal(c, ".", "$1")) == ["a$1b", "axb"]


def test_keyword(spark):
    assert evaluate(spark, ["Alpha", "beta"], lambda c: text.contains_keyword(c, "AL")) == [True, False]
    assert evaluate(spark, ["Alpha"], lambda c: text.contains_keyword(c, " al ", trim_keyword=True)) == [True]
    assert evaluate(spark, ["Alpha"], lambda c: text.contains_keyword(c, " al ")) == [False]
    assert evaluate(spark, ["Alpha"], lambda c: text.contains_keyword(c, "")) == [True]


def test_humanized_messages(spark):
    values = ["[IM002] x", "Error 22018: HY000", "[HY000] y", "plain", "", "String or binary data would be truncated"]
    got = evaluate(spark, values, messages.humanize)
    table = dict(messages.WRITER_ERROR_TEXT)
    assert got == [table["im002"], table["22018"], table["hy000"], "plain", "", table["string or binary data would be truncated"]]


@pytest.mark.parametrize(
    ("kind", "message", "expected"),
    [
        ("null", "x", "必填字段为空，请补填"),
        ("date", "x", "日期格式无法识别（应形如 2024-01-31）"),
        ("length", "x", "字段值超长，请缩短后重试"),
        ("db", " \n first " + "y" * 80 + "\nsecond", ("first " + "y" * 80)[:60]),
        ("db", "  ", "未知错误"),
        ("db", None, "未知错误"),
        ("other", "[08S01] gone", "网络连接中断，请确认数据库服务器可达后重试。"),
    ],
)
def test_problem_text(spark, kind, message, expected):
    df = spark.createDataFrame([(kind, message)], "kind string, message string")
    assert df.select(messages.problem_text(F.col("kind"), F.col("message"))).first()[0] == expected


def test_reason_labels(spark):
    assert evaluate(spark, ["NOT NULL", "LENGTH", "DATE", "TYPE", "X"], messages.reason_label) == [
        "空值(必填)", "超长", "日期非法", "类型不符", "X"]


def test_column_letters_and_labels():
    assert [schema.column_letter(n) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    labels = schema.column_labels()
    assert labels["company_name"] == "D列 企业名称"
    assert schema.column_labels([schema.FieldMapping(1, "x", 26, "")]) == {"x": "AA列 x"}
    assert schema.default_table_name(7) == "enterprise_info_007"
