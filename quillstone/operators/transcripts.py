"""Transcripts: kinds of lines, speech units by an automaton over each record's lines, roles of speakers and licences."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of names that are roles or bodies, groups that are nobody in particular, words before a name.
ROLE = "(?:内閣総理大臣|総理大臣|総理|大臣政務官|政務官|副大臣|大臣|内閣官房長官|官房長官|委員長|座長代理|座長|議長代理|議長|構成員|委員|主査|副本部長|本部長|統括官|審議官|参事官|事務局長|局長|次長|室長|部長|課長)"
BODY = "(?:省|庁|府|事務局|推進室|委員会|会議|研究会|本部)"
GROUP = "^(各|出席|関係|他の|一部の)?(構成員|委員|出席者|有識者|府省庁|関係府省庁|閣僚)(の皆様)?$"
BEFORE_NAME = "^(次に|また|冒頭|最後に|続いて|その後)、?"
BEFORE_SPEAKER = "^(次に|また|冒頭|最後に|続いて|その後|議論に先立ち)、?"

#: Forms of a record's lines, the first that fits; group 1 is a name where there is one, group 2 what is said.
#: Both marks of a speaker's line, the circle and the ideographic zero, are the same. A line of another form is "text".
LINE_FORMS = {
    "paren_latin": r"^[○〇]([A-Za-z0-9][^、。「」()]{0,40}?\([^()]{2,40}\))(?:\s+(.*))?$",
    "paren": r"^[○〇]([^\s、。「」()]{1,40}\([^()]{2,40}\))(?!専門委員|委員|座長)\s*(.*)$",
    "body": r"^[○〇]([^\s、。「」()]{1,20}?(?:省|庁))()$",
    "verbatim": r"^[○〇](?!\S*(?:より|から))([^\s、。]{2,40})\s+(.*)$",
    "alone": rf"^[○〇]([^\s、。「」]{{1,30}}?{ROLE})()$",
    "guest": r"^[○〇]([^\s、。「」()]{2,12}氏)()$",
    "tight": rf"^[○〇]([^\s、。「」]{{1,30}}?{ROLE})(?!より|から)(\S.*)$",
    "heading": r"^【([^】]{1,40})】\s*(.*)$",
    "narration": r"^[○〇]\s*()(.*)$",
    "bullet": r"^[・･]\s*()(.*)$",
    "note": r"^※\s*()(.*)$",
}
_FORMS = [(k, re.compile(p)) for k, p in LINE_FORMS.items()]
# Other forms that the automaton asks for.
_OPENS = re.compile(r"より|から|。|、")
_NAMED_BULLET = re.compile(r"^(?:\d+\s*)?([^、。「」\s]{2,40}?)から、?\s*「")
_SPEAKERS = re.compile(r"([^、。「」\s]{2,40}?)(?:より|から)")
_OPINIONS = re.compile(r"(構成員|委員|出席者)(から|より|の)(主な)?(意見|発言|御発言)")
_FOLLOWS, _HANDED_IN, _MARK = "以下のとおり", "提出のあった", re.compile(r"^\s*[○〇【・･※]")
_SECTION = re.compile(r"^[<＜][^>]*[>＞]$")
_PAREN_HEAD = re.compile(r"^[(（]([^()（）]{1,30})[)）]\s*(.*)$")
_MARK_ONLY = re.compile(r"^[⚫●•◼■➢▶o・･]\s*$")
_BULLET_MARKS = ("○", "〇", "⚫", "●", "\uf06e")
AGENDA = {"heading": r"^\d+\s*[.．]\s*議事$", "anon_marks": r"^[■◼]?\s*議事概要$"}
STYLES = ("", "split_mark", "heading", "anon_marks", "paren")
UNITS = "unit int, mode string, speaker string, first_line long, start_page int, end_page int, text string"


def line_form(text: Column) -> Column:
    """The form of a line, as the automaton reads it: blank, a key of LINE_FORMS, or text."""
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"^([○〇])[○〇]+(?=\S)", "$1")
    out = F.lit("text")
    for kind, pattern in reversed(LINE_FORMS.items()):
        out = F.when(line.rlike("(?U)" + pattern), kind).otherwise(out)
    return F.when(line == "", "blank").otherwise(out)


def is_named(name: str, titles: tuple[str, ...] = ()) -> bool:
    """A role, a body, or an ending in titles: somebody in particular, not a group."""
    name = re.sub(BEFORE_NAME, "", name)
    if re.match(GROUP, name) or (titles and re.fullmatch("(各|有識者)?(" + "|".join(map(re.escape, titles)) + ")", name)):
        return False
    return bool(re.search(f"{ROLE}$|{BODY}$", name)) or any(name.endswith(t) and len(name) > len(t) for t in titles)


def narration_speakers(sentence: str) -> tuple[str | None, str | None]:
    """(whom a narration tells of, who speaks in the bullets below it): a name, ANON for a group's opinions, or None."""
    body = re.sub(r"^[○〇]\s*", "", sentence)
    names = [re.sub(BEFORE_SPEAKER, "", m.group(1)).strip() for m in _SPEAKERS.finditer(body)]
    people = list(dict.fromkeys(n for n in names if is_named(n)))
    single = people[0] if len(people) == 1 else None
    groups = any(re.match(GROUP, n.rpartition("、")[2]) for n in names)
    if groups or _OPINIONS.search(body):
        return None if groups else single, "ANON"
    return single, single if single and _FOLLOWS in body else None


class Lines:
    """Lines (number, page, text) one after another, with a look at those ahead."""

    def __init__(self, lines: Iterable[tuple[int, int, str]]):
        self.source, self.held = iter(lines), deque()

    def __iter__(self):
        return self

    def __next__(self):
        return self.held.popleft() if self.held else next(self.source)

    def ahead(self, i: int):
        """The line i places ahead, or None; as many lines are held as are looked over."""
        while len(self.held) <= i:
            if (line := next(self.source, None)) is None:
                return None
            self.held.append(line)
        return self.held[i]

    def sentence(self, line: str) -> str:
        """line and those after it up to the first full stop, but no further than a marked line."""
        text, i = line.strip(), 0
        while "。" not in text and (more := self.ahead(i)) and not _MARK.match(more[2]):
            text, i = text + more[2].strip(), i + 1
        return text.split("。")[0]


def _marks_joined(lines: Iterable[tuple[int, int, str]], tight: bool) -> Iterator[tuple[int, int, str]]:
    """A mark alone on its line joined to the line after it; tight: a speaker's mark without a space between."""
    lines = iter(lines)
    for number, page, text in lines:
        mark = text.strip()
        if mark in ("○", "〇", "・") and (after := next(lines, None)):
            text = mark + ("" if tight and mark != "・" else " ") + after[2].strip()
        yield number, page, text


@dataclass
class Open:
    """The unit in work."""

    mode: str
    speaker: str | None
    first_line: int
    start_page: int
    end_page: int
    text: str = ""

    def add(self, page: int, text: str) -> None:
        self.text, self.end_page = self.text + text.strip(), page


def _opens(text: str) -> bool:
    """Does the record's body begin here: a marked sentence, or a speaker alone on a line."""
    line = text.strip()
    if re.match(r"^[○〇]", line) and _OPENS.search(line):
        return True
    paren = dict(_FORMS)["paren"].match(line)
    return bool(dict(_FORMS)["alone"].match(line) or (paren and not paren.group(2)))


def units_of(lines: Iterable[tuple[int, int, str]], style: str = "", titles: tuple[str, ...] = (), agenda: int | None = None, marked: bool = True, opened: bool = True) -> Iterator[Open]:
    """The units of one record's lines; lines before its body come as units of mode head, one a line.

    agenda is the line of the record's agenda heading, marked whether any line has a mark, opened whether a body begins by
    the common rule: the styles heading and anon_marks ask for them, as they can't be seen from the lines before.
    """
    if style == "paren":
        yield from _paren_units(lines)
        return
    if style == "anon_marks":
        lines = ((n, p, "・" if t.strip() in _BULLET_MARKS else t) for n, p, t in lines)
        if not marked:
            lines = ((n, p, re.sub(r"^\s+(?=[^\s【<＜\d])", "・", t)) for n, p, t in lines)
    stream = Lines(_marks_joined(lines, style == "split_mark"))
    cur, context, context_mode, handed_in, in_body, first = None, None, "named", False, False, None
    for number, page, raw in stream:
        first = number if first is None else first
        text = raw.strip()
        if not in_body:
            begun = number > (first if agenda is None else agenda)
            in_body = _opens(text) or (style == "heading" and begun and bool(dict(_FORMS)["heading"].match(text))) or (style == "anon_marks" and not opened and begun and bool(dict(_FORMS)["bullet"].match(text)))
            if not in_body:
                yield Open("head", None, number, page, page, text)
                continue
        text = re.sub(r"^([○〇])[○〇]+(?=\S)", r"\1", text)
        kind, match = next(((k, m) for k, f in _FORMS if (m := f.match(text))), ("text", None))
        name, said = (match.group(1), match.group(2) or "") if match else (None, text)
        new = None
        if kind in ("paren_latin", "paren", "body", "verbatim"):
            new, context, handed_in = ("verbatim", name, said), None, False
        elif kind in ("alone", "guest", "tight"):
            new, context = ("written" if handed_in else "verbatim", name, said), None
        elif kind == "heading":
            name = name.replace("提出者:", "提出者：")
            if name.startswith("提出者："):
                new, context = ("written", name.split("：", 1)[1].strip(), said), None
            else:
                context, context_mode = (name if is_named(name, titles) else None), "named"
                if said:
                    new = ("named", name, said) if context else ("anonymous", None, said)
                else:
                    if cur:
                        yield cur
                    cur = None
                    continue
        elif kind == "narration":
            sentence = stream.sentence(text)
            who, context = narration_speakers(sentence)
            context_mode, handed_in = "named", _HANDED_IN in sentence
            new = ("narration", who, said)
        elif kind == "bullet" and cur and cur.mode in ("verbatim", "written") and context is None:
            cur.add(page, text)
            continue
        elif kind == "bullet":
            bullet = _NAMED_BULLET.match(said)
            if bullet and is_named(bullet.group(1), titles):
                new = ("named", bullet.group(1), said)
            elif context and context != "ANON":
                new = (context_mode, context, said)
            else:
                new = ("anonymous", None, said)
        elif style == "anon_marks" and _SECTION.match(text):
            if cur:
                yield cur
            cur, context = None, None
            continue
        elif kind == "note":
            new, context, handed_in = ("narration", None, said), None, _HANDED_IN in text
        elif cur is None:
            named = context and context != "ANON"
            new = (context_mode, context, text) if named else ("anonymous", None, text)
        else:
            cur.add(page, text)
            continue
        if cur:
            yield cur
        cur = Open(new[0], new[1], number, page, page, new[2].strip())
    if cur:
        yield cur


def _paren_units(lines: Iterable[tuple[int, int, str]]) -> Iterator[Open]:
    """Style paren: the body follows the agenda's heading; (name) begins a summary, marks and <sections> end one."""
    stream, cur, in_body, before = Lines(lines), None, False, ""
    for number, page, raw in stream:
        text = raw.strip()
        if not in_body:
            in_body = bool(re.fullmatch(r"[◼■]\s*議事", text)) or (text == "議事" and before in ("◼", "■"))
            before = text
            yield Open("head", None, number, page, page, text)
            continue
        match = _PAREN_HEAD.match(text)
        ends = not text or _MARK_ONLY.match(text) or _SECTION.match(text)
        if cur and (ends or match):
            yield cur
            cur = None
        if ends:
            continue
        if match:
            name = match.group(1).strip()
            named = is_named(name)
            cur = Open("named" if named else "anonymous", name if named else None, number, page, page, match.group(2).strip())
        elif cur is None:
            who, _ = narration_speakers(stream.sentence(text))
            who = re.split("[をはがにでと]", who)[-1] if who else None
            cur = Open("narration", who if who and is_named(who) else None, number, page, page, text)
        else:
            cur.add(page, text)
    if cur:
        yield cur


def speech_units(lines: DataFrame, doc: str, order: str, page: str, text: str, style: str = "", titles: tuple[str, ...] = ()) -> DataFrame:
    """doc, unit, mode, speaker, first_line, start_page, end_page, text: the units of each record, in order.

    mode: verbatim, written, named, anonymous or narration; head is a line before the record's body (unit 0). speaker is
    null where the record doesn't say who speaks: nothing is inferred. A speaker's line begins a unit; a narration or
    heading sets who speaks in the bullets below; units without text are left out.

    An automaton goes once over each record's lines, dealt by record and in order: a task holds one unit and the lines
    of one sentence, however long the record. What it must know of lines to come is aggregated before, for the two
    styles that need it. Null texts count as empty lines. order must be an integer that is unique in a record.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    rows = lines.select(F.col(doc).alias("doc"), F.col(order).cast("long").alias("line"), F.col(page).cast("int").alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType
    if style in AGENDA:
        line = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
        marked = (line.isin("・", *_BULLET_MARKS)) | line.rlike(r"^[○〇・]\S")
        opened = (line.rlike("^[○〇]") & ~line.isin(*_BULLET_MARKS) & line.rlike(_OPENS.pattern)) | line.rlike("(?U)" + LINE_FORMS["alone"]) | (line.rlike("(?U)" + LINE_FORMS["paren"]) & (F.regexp_extract(line, "(?U)" + LINE_FORMS["paren"], 2) == ""))
        known = rows.groupBy(F.col("doc").alias("of")).agg(F.min(F.when(line.rlike("(?U)" + AGENDA[style]), F.col("line"))).alias("agenda"), F.max(marked).alias("marked"), F.max(opened).alias("opened"))
        rows = rows.join(known, F.col("doc").eqNullSafe(F.col("of"))).drop("of")
    else:
        rows = rows.select("*", F.lit(None).cast("long").alias("agenda"), F.lit(True).alias("marked"), F.lit(True).alias("opened"))

    def run(batches):
        each = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        out = []

        def flushed():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], names=schema.names)

        for of, group in groupby(each, lambda r: r[0]):
            first = next(group)
            number = 0
            for u in units_of((r[1:4] for r in chain([first], group)), style, titles, *first[4:]):
                if u.mode != "head" and not u.text:
                    continue
                number += u.mode != "head"
                out.append((of, number if u.mode != "head" else 0, u.mode, u.speaker, u.first_line, u.start_page, u.end_page, u.text))
                if len(out) == 2000:
                    yield flushed()
                    out.clear()
        if out:
            yield flushed()

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc", to_arrow_type(kind)), ("unit", pa.int32()), ("mode", pa.string()), ("speaker", pa.string()), ("first_line", pa.int64()), ("start_page", pa.int32()), ("end_page", pa.int32()), ("text", pa.string())])
    return rows.repartition("doc").sortWithinPartitions("doc", "line").mapInArrow(run, f"doc {kind.simpleString()}, {UNITS}").withColumnRenamed("doc", doc)


@dataclass(frozen=True)
class Meeting:
    """What is known of the body whose record is read."""

    name: str = ""
    #: Names of its secretariat.
    secretariat: tuple[str, ...] = ()
    #: It hears parties from outside.
    hearing: bool = False
    #: Endings of names that only here are members.
    member_titles: tuple[str, ...] = ()
    #: Its list of those present has a section for the secretariat.
    attendee_sections: bool = False


# Endings and words of names by which roles are told.
_POLITICAL = r"(内閣総理大臣|総理大臣|総理|大臣政務官|政務官|副大臣|大臣|内閣官房長官|官房長官)(\(代理\))?$|大臣|国家公安委員会委員長"
_MEMBER = "(構成員|委員|座長代理|座長|主査)$"
_OFFICIAL = "(統括官|審議官|参事官|事務局長|局長|次長|室長|部長|課長)$"
_BODIES = "(省|庁|府|事務局|推進室|委員会|会議|研究会|本部|審議会)$"
_EXTERNAL = "株式会社|有限会社|代表取締役|取締役|社長|理事長|会長|協会|連合会|会議所|財団|社団|大学|機構|法人"
_HEARING_EXTERNAL = "研究所|教授|弁護士|組合|連盟|(県|市|町|村)$"
_ADVISER = "(科技|科学技術)顧問$"
_OTHER_CHAIR, _CHAIR = "(会議|本部|審議会)議長(代理)?$", "議長(代理)?$"
#: Licences by kind of presenter: what a government body presents may be reused, others' material is theirs.
GOVERNMENT = ("political", "secretariat", "ministry")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")


def _quoted(text: Column) -> Column:
    """A pattern for the text itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def _near(head: Column, before: str, name: Column, after: str) -> Column:
    """Group 1 of a pattern with the name in its middle, in the list of those present; empty if it isn't there."""
    found = F.call_function("regexp_extract", head, F.concat(F.lit(before), _quoted(name), F.lit(after)), F.lit(1))
    return F.when(name != "", found).otherwise("")


def _listed(head: Column, section: str, name: Column) -> Column:
    """Is the name in a section of the list of those present."""
    return (name != "") & F.exists(F.regexp_extract_all(head, F.lit(section), F.lit(1)), lambda part: F.contains(part, name))


def speaker_role(speaker: Column, meeting: Meeting = Meeting(), head: Column | None = None) -> Column:
    """political, secretariat, ministry, member, external or unknown, of a speaker as the record names them.

    head is the record's list of those present. Nothing is inferred: who fits no rule is unknown. A ministry's
    secretariat officials (大臣官房) are officials and not political, and the chair of the public safety commission is
    political though a commission's chair.
    """
    name, head = _bare(speaker), _bare(head if head is not None else F.lit(""))
    own, ours = _bare(F.lit(meeting.name)), [re.sub(r"\s", "", x) for x in meeting.secretariat]
    no = F.lit(False)

    def is_secretariat(n: Column) -> Column:
        out = no
        for x in ours:
            out |= F.contains(n, F.lit(x))
        return out | (F.contains(n, own) & F.endswith(n, F.lit("事務局")))

    surname = F.regexp_replace(name, _OFFICIAL, "")
    sections = r"[(〈【]事務局[)〉】](.*?)(?=[(〈【](?!Web|WEB|web|オンライン|代理)[^)〉】]{1,12}[)〉】]|$)"
    hearing_section = r"\(事務局\)(.*?)(?=\((?:委員等|関係者|有識者|説明者)\)|$)"
    guest = _near(head, r"\(", F.regexp_replace(name, "氏$", ""), r"([^()]{1,60})\)")
    guest_role = F.when(guest.rlike(f"{_EXTERNAL}|{_HEARING_EXTERNAL}|[A-Za-z]"), "external").when(guest.rlike("省|庁"), "ministry").otherwise("unknown")
    org, person = F.regexp_extract(name, r"^(.+?)\(([^()]{2,})\)$", 1), F.regexp_extract(name, r"^(.+?)\(([^()]{2,})\)$", 2)
    person_name = F.regexp_replace(person, _OFFICIAL, "")
    hearing_role = (
        F.when(org.rlike(_POLITICAL), "political").when(is_secretariat(org) | _listed(head, hearing_section, person_name), "secretariat")
        .when(org.rlike(f"{_EXTERNAL}|{_HEARING_EXTERNAL}"), "external").when(org.rlike("(省|庁|府)$"), "ministry").otherwise("external")
    )
    chair = _near(head, "", F.regexp_replace(name, _CHAIR, ""), r".{0,8}?([^\s]{0,30}?(?:会議|本部|審議会)議長(?:代理)?)")
    title = _near(head, "", surname, r".{0,6}?([^\s]{0,40}?" + _OFFICIAL.rstrip("$") + ")")
    in_list = no
    if meeting.hearing:
        in_list |= _listed(head, hearing_section, surname)
    if meeting.attendee_sections:
        in_list |= _listed(head, sections, surname)
    official = F.when(is_secretariat(name) | in_list | ((title != "") & is_secretariat(title)), "secretariat").otherwise("ministry")
    bureau = F.contains(name, F.lit("大臣官房")) & name.rlike(_OFFICIAL)
    member = no
    for t in meeting.member_titles:
        member |= F.endswith(name, F.lit(t)) & (F.length(name) > len(t))
    return (
        F.when((name == "") | (name == "不明"), "unknown")
        .when(F.endswith(name, F.lit("氏")) & (guest != ""), guest_role)
        .when(F.lit(meeting.hearing) & (org != ""), hearing_role)
        .when(name.rlike(_ADVISER), "unknown")
        .when(~bureau & (F.contains(name, F.lit("国家公安委員会委員長")) | name.rlike(_POLITICAL)), "political")
        .when(member, "member")
        .when(name.rlike(_OTHER_CHAIR), "ministry")
        .when(name.rlike(_CHAIR), F.when(chair != "", "ministry").otherwise("unknown"))
        .when(name.rlike(_MEMBER), "member")
        .when(name.rlike(_OFFICIAL), official)
        .when((name == "事務局") | is_secretariat(name), "secretariat")
        .when(name.rlike(_EXTERNAL), "external")
        .when(name.rlike(_BODIES), "ministry")
        .when(F.lit(meeting.hearing) & name.rlike(_HEARING_EXTERNAL), "external")
        .otherwise("unknown")
    )


def licence_of(role: Column) -> Column:
    """government or third_party by the presenter's role; of an unknown presenter nothing is said."""
    return F.when(role == "unknown", F.lit(None)).when(role.isin(*GOVERNMENT), "government").otherwise("third_party")


def page_quality(text: Column, least: int = 100) -> Column:
    """sparse below so many characters that are no white space, lines of a page number alone left out; else full."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*[-‐－]?\s*[0-9０-９]{1,4}\s*[-‐－]?\s*$", ""), r"\s", "")
    return F.when(F.coalesce(F.length(body), F.lit(0)) < least, "sparse").otherwise("full")
