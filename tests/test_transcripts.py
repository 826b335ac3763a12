"""Transcripts: every form of line, the automaton's context, its five styles, and the roles of speakers."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import transcripts as tr


def parsed(lines, style="", **known):
    lines = lines.split("\n") if isinstance(lines, str) else lines
    return [(u.mode, u.speaker, u.text) for u in tr.units_of(((i, 1 + i // 4, t) for i, t in enumerate(lines)), style, **known) if u.mode != "head" and u.text]


START = "○司会座長\n"


@pytest.mark.parametrize(
    "line,form",
    [
        ("○平デジタル大臣 ただいまから", "verbatim"), ("〇平デジタル大臣　ただいまから", "verbatim"), ("○国土交通省(堤審議官)", "paren"),
        ("○DAIWA CYCLE株式会社(伊藤営業本部長) では", "paren_latin"), ("〇厚生労働省", "body"), ("〇高市内閣総理大臣", "alone"), ("○長澤仁志氏", "guest"), ("〇山田座長では始めます", "tight"),
        ("〇 高市内閣総理大臣より、以下のとおり発言があった。", "narration"), ("○事務局より 説明", "narration"), ("【伊藤委員】 本文", "heading"), ("・項目", "bullet"), ("･項目", "bullet"), ("※注", "note"),
        ("○○福田委員", "alone"), ("本文", "text"), ("　", "blank"), ("○村上(文)専門委員　はい", "verbatim"),
    ],
)
def test_forms_of_lines(spark, line, form):
    assert spark.createDataFrame([(line,)], "t string").select(tr.line_form(F.col("t"))).first()[0] == form


def test_speakers_lines():
    assert parsed("出席者\n○AI戦略会議 構成員\n〇平大臣 ただいまから、\n始めます。\n○厚生労働省\n資料です。\n○国土交通省(堤 審議官)\n・一つ\n・二つ\n○長澤仁志氏\nどうも。\n〇山田座長では次に") == [
        ("verbatim", "平大臣", "ただいまから、始めます。"), ("verbatim", "厚生労働省", "資料です。"), ("verbatim", "国土交通省(堤 審議官)", "・一つ・二つ"), ("verbatim", "長澤仁志氏", "どうも。"), ("verbatim", "山田座長", "では次に"),
    ]


def test_a_narration_sets_who_speaks_in_the_bullets():
    text = START + "〇 高市内閣総理大臣より、以下のとおり\n発言があった。\n・一つ\n続き\n・林総務大臣から、「二つ」といった発言があった。\n○ 構成員からの主な意見\n・三つ\n※ 注記\n・四つ\n○ 平大臣から説明し、赤澤大臣から補足した。\n・五つ"
    assert parsed(text) == [
        ("narration", "高市内閣総理大臣", "高市内閣総理大臣より、以下のとおり発言があった。"), ("named", "高市内閣総理大臣", "一つ続き"), ("named", "林総務大臣", "林総務大臣から、「二つ」といった発言があった。"),
        ("narration", None, "構成員からの主な意見"), ("anonymous", None, "三つ"), ("narration", None, "注記"), ("anonymous", None, "四つ"), ("narration", None, "平大臣から説明し、赤澤大臣から補足した。"), ("anonymous", None, "五つ"),
    ]


def test_headings_and_written_opinions():
    text = START + "【伊藤委員】\n・一つ\n・二つ\n【論点】\n・三つ\n【提出者:村岡構成員】\n・四つ\n・五つ\n※ 提出のあった発言は以下のとおり\n○鈴木委員\n六つ\n○佐藤委員　七つ\n○田中委員\n八つ"
    assert parsed(text) == [
        ("named", "伊藤委員", "一つ"), ("named", "伊藤委員", "二つ"), ("anonymous", None, "三つ"), ("written", "村岡構成員", "・四つ・五つ"), ("narration", None, "提出のあった発言は以下のとおり"),
        ("written", "鈴木委員", "六つ"), ("verbatim", "佐藤委員", "七つ"), ("verbatim", "田中委員", "八つ"),
    ]


def test_a_mark_on_a_line_of_its_own():
    assert parsed("○\n平大臣より、挨拶があった。\n・\n項目") == [("narration", "平大臣", "平大臣より、挨拶があった。"), ("anonymous", None, "項目")]
    assert parsed("○\n平野部長　はい、始めます", "split_mark") == [("verbatim", "平野部長", "はい、始めます")]
    assert parsed(START + "○○福田委員\nはい") == [("verbatim", "福田委員", "はい")]


def test_style_heading_begins_after_the_agenda():
    text = "資料\n【非公開】\n6.議事\n【伊藤委員】\n一つ\n【論点】 二つ"
    assert parsed(text, "heading", agenda=2) == [("named", "伊藤委員", "一つ"), ("anonymous", None, "二つ")]


def test_style_anon_marks():
    text = "議事概要\n○\n一つ\n⚫\n二つ\n<議題2 について>\n○\n三つ"
    assert parsed(text, "anon_marks", agenda=0, opened=False) == [("anonymous", None, "一つ"), ("anonymous", None, "二つ"), ("anonymous", None, "三つ")]
    text = "議事概要\n 一つ\n続き\n 二つ"
    assert parsed(text, "anon_marks", agenda=0, marked=False, opened=False) == [("anonymous", None, "一つ続き"), ("anonymous", None, "二つ")]


def test_style_paren():
    text = "2. 議事\n◼\n議事\n冒頭、平大臣から、挨拶があった。\n(伊藤委員)一つ\n続き\n<質疑>\n（参加者）二つ\n●\n事務局より、説明した。"
    assert parsed(text, "paren") == [("narration", "平大臣", "冒頭、平大臣から、挨拶があった。"), ("named", "伊藤委員", "一つ続き"), ("anonymous", None, "二つ"), ("narration", "事務局", "事務局より、説明した。")]


def test_a_record_without_a_body_is_its_head():
    assert [u.mode for u in tr.units_of([(1, 1, "出席者"), (2, 1, ""), (3, 1, "以上")])] == ["head"] * 3


def test_a_long_record_is_followed_line_by_line():
    def lines():
        yield 0, 1, "○司会座長"
        for i in range(1, 200_000):
            taken[0] = i
            yield i, i // 40, "○鈴木委員" if i % 5 == 1 else "はい。"

    taken = [0]
    units = tr.units_of(lines())
    next(units), next(units)
    assert taken[0] < 20
    assert sum(1 for _ in units) == 40_000 - 1


def test_units_over_a_table(spark):
    """Any order of rows and partitions, several records in a task, nulls, and styles that look ahead by aggregates."""
    a = "出席者\n○山田座長\nはい\n・一つ\n〇鈴木委員　ええ".split("\n")
    b = "7. 議事\n【伊藤委員】\n・二つ".split("\n")
    rows = [(d, i, i // 2, t) for d, doc in (("a", a), ("b", b), (None, a)) for i, t in enumerate(doc)] + [("c", 0, 0, None)]
    df = spark.createDataFrame(rows, "rec string, n int, p int, t string").repartition(5)
    got = sorted(map(tuple, tr.speech_units(df, "rec", "n", "p", "t").filter("mode <> 'head' AND rec = 'a'").collect()))
    assert got == [("a", 1, "verbatim", "山田座長", 1, 0, 1, "はい・一つ"), ("a", 2, "verbatim", "鈴木委員", 4, 2, 2, "ええ")]
    got = tr.speech_units(df, "rec", "n", "p", "t", style="heading")
    assert [tuple(r)[2:5] for r in got.filter("rec = 'b' AND mode <> 'head'").collect()] == [("named", "伊藤委員", 2)]
    assert got.filter("rec IS NULL AND mode = 'verbatim'").count() == 2
    assert tr.speech_units(df.limit(0), "rec", "n", "p", "t").collect() == []
    with pytest.raises(ValueError):
        tr.speech_units(df, "rec", "n", "p", "t", style="other")


HEAD = "出席者 鈴木委員 (長澤 仁志 一般社団法人日本船主協会会長)(関係者)佐藤課長 (事務局)大平参事官、谷輔 室長 (有識者)森教授 〈事務局〉嶋崎参事官 渡辺審議官 〈説明者〉 濱野内閣府規制事務室長 田中総合会議議長"


@pytest.mark.parametrize(
    "name,role,meeting",
    [
        ("奥野大臣官房審議官", "ministry", {}), ("国家公安委員会委員長", "political", {}), ("高市内閣総理大臣", "political", {}), ("平大臣(代理)", "political", {}), ("沖外務大臣科技顧問", "unknown", {}),
        ("鈴木委員", "member", {}), ("山田座長", "member", {}), ("科学会議議長", "ministry", {}), ("田中議長", "ministry", {}), ("木村議長", "unknown", {}), ("長澤仁志氏", "external", {}), ("誰某氏", "unknown", {}),
        ("佐藤課長", "ministry", {}), ("事務局", "secretariat", {}), ("規制会議事務局", "secretariat", {}), ("規制事務室", "secretariat", {}), ("規制事務室参事官", "secretariat", {}), ("濱野室長", "secretariat", {}),
        ("大平参事官", "ministry", {}), ("大平参事官", "secretariat", {"hearing": True}), ("嶋崎参事官", "ministry", {}), ("嶋崎参事官", "secretariat", {"attendee_sections": True}),
        ("日本船主協会", "external", {}), ("厚生労働省", "ministry", {}), ("菊永弁護士", "unknown", {}), ("菊永弁護士", "external", {"hearing": True}),
        ("国土交通省(堤大臣官房審議官)", "ministry", {"hearing": True}), ("北町株式会社(島田部長)", "external", {"hearing": True}), ("平大臣(ビデオメッセージ)", "political", {"hearing": True}), ("規制事務室(大平参事官)", "secretariat", {"hearing": True}),
        ("宮園議員", "unknown", {}), ("宮園議員", "member", {"member_titles": ("議員",)}), ("議員", "unknown", {"member_titles": ("議員",)}), ("不明", "unknown", {}), (None, "unknown", {}), ("a.*b氏", "unknown", {}),
    ],
)
def test_roles(spark, name, role, meeting):
    df = spark.createDataFrame([(name, HEAD)], "s string, h string")
    got = df.select(tr.speaker_role(F.col("s"), tr.Meeting("規制会議", ("規制事務室",), **meeting), F.col("h"))).first()[0]
    assert got == role
