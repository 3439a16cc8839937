"""Archives and conversations: exact round trips."""

from __future__ import annotations

import hashlib
import struct

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from corpusmill.llm.chat import CHAT_TEMPLATE, FILTERS, digest_conversations, format_conversations, guard, op10_chat_format, read_turns, unguard
from corpusmill.llm.templates import Template, TemplateError, _Compiler, parse
from corpusmill.llm.warc import op7_warc_bundles, parse_records, read_bundles, read_record, seek_table, with_revisits, write_bundles

PAGES = "page_id long, url string, html string"
ODD_PAGES = [
    (1, "http://a/ä b\r\nX: y", "<p>é\r\n\r\nWARC/1.1</p>" * 10), (2, None, None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"),
    (6, "u", "long" * 100), (9, "u", "long" * 100), (8, "u", "long" * 100), (None, "u", "long" * 100), (7, "u", "y" * 99), (10, "u", "y" * 99),
    (6, "u", "long" * 100), (11, "v", "z" * 3_000_000), (None, "w", "n" * 200), (None, "w", "n" * 200),
]


def test_pages_round_trip(spark, tmp_path):
    frame = spark.createDataFrame(ODD_PAGES, PAGES)
    frame.withColumn("digest", F.lit("clash")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(row) for row in op7_warc_bundles(spark, str(tmp_path)).fillna(-1, ["page_id"]).collect())
    want = []
    for page_id, _, html in ODD_PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in ODD_PAGES if (h or "").encode() == data and p is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and page_id != first
        want.append((-1 if page_id is None else page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=lambda r: r)


def test_bundles_are_seekable_zstandard(spark, tmp_path):
    rows = [(at, f"http://x/{at}", f"<p>{at}</p>" * 3000) for at in range(60)]
    target = f"{tmp_path}/archive"
    index = write_bundles(with_revisits(spark.createDataFrame(rows, PAGES).repartition(2)), target)
    entries = index.collect()
    assert len(entries) == 60 and len({(e.file, e.frame) for e in entries}) > 4
    for entry in entries:
        headers, block = read_record(f"{target}/{entry.file}", entry.frame, entry.offset)
        assert headers["WARC-Record-ID"].endswith(f":{entry.page_id}>")
        assert block.split(b"\r\n\r\n", 1)[1] == f"<p>{entry.page_id}</p>".encode() * 3000
    for name in {e.file for e in entries}:
        with open(f"{target}/{name}", "rb") as file:
            data = file.read()
        # Any reader of the format sees all records; the table tells where frames start.
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        mine = [e for e in entries if e.file == name]
        assert len(list(parse_records(plain))) == len(mine)
        assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
        with fs.LocalFileSystem().open_input_file(f"{target}/{name}") as file:
            table = seek_table(file)
        assert {e.frame: e.frame_start for e in mine} == {at: row[0] for at, row in enumerate(table)}
        assert sum(row[2] for row in table) == len(plain)
    assert {row.payload for row in read_bundles(index, target).collect()} == {html.encode() for _, _, html in rows}


def test_payloads_follow_decisions_on_both_ways(spark, tmp_path, monkeypatch):
    from corpusmill.llm import warc

    frame = spark.createDataFrame([(*row, "x", 1) for row in ODD_PAGES], PAGES + ", size string, refers_to int")
    want = sorted(map(tuple, with_revisits(frame).fillna(-1, ["page_id"]).collect()), key=repr)
    assert all((html is None) == (refers is not None) for _, _, html, _, _, refers in want)
    monkeypatch.setattr(warc, "fits_broadcast", lambda frame: False)
    assert sorted(map(tuple, with_revisits(frame).fillna(-1, ["page_id"]).collect()), key=repr) == want


def test_frames_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from corpusmill.llm import warc

    monkeypatch.setattr(warc, "READ_BYTES", 200_000)
    rows = [(at, f"http://x/{at}", f"<p>{at}</p>" * 1500) for at in range(200)]
    target = f"{tmp_path}/archive"
    index = write_bundles(with_revisits(spark.createDataFrame(rows, PAGES).repartition(2)), target)
    found = read_bundles(index, target).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(row.page_id for row in found) == list(range(200))
    assert len({row.task for row in found}) >= 8


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert op7_warc_bundles(spark, str(tmp_path)).collect() == []


TALKS = "conv_id long, turn long, role string, text string"
HARD = ["", "</turn>", "\\</turn>", "x\\", "\\\\<turn \"user\">\n", "<turn", "a\n</turn>\nb", "é\u2028 ☃ 🎉", "\\turn </TURN> < turn", "<turn \"assistant\">\nx\n</turn>\n"]


def test_guard_is_reversible():
    for text in HARD + [a + b for a in HARD for b in HARD]:
        assert unguard(guard(text)) == text
        assert "\n</turn>" not in "\n" + guard(text) and "<turn" not in guard(text).replace("\\<turn", "")


def test_conversations_round_trip(spark, tmp_path):
    rows = [(1, at, "assistant" if at % 2 else "user", text) for at, text in enumerate(HARD)]
    rows += [(2, None, None, None), (2, 5, 'we"ird>\n role', "x"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (2, -1, "system", "s"), (None, 0, "assistant", "no id")]
    rows += [(3, at, "assistant", f"t{at} ") for at in range(1000)]
    frame = spark.createDataFrame(rows, TALKS).withColumn("position", F.lit("clash"))
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {row.conv_id: row for row in op10_chat_format(spark, str(tmp_path)).collect()}
    control = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    assert set(got) == {1, 2, 3, None, -7}
    template = Template(CHAT_TEMPLATE, FILTERS)
    for conv in got:
        turns = sorted((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        whole, spans = template.render([{"role": role, "text": text} for _, _, role, text in turns])
        assert tuple(got[conv])[1:] == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)
        )
        assert [(role, text) for _, _, role, text in turns] == list(read_turns(whole))
        assert "".join(unguard(whole[a:b]) for a, b in spans) == loss
    pieces = format_conversations(frame.filter("conv_id = 3")).orderBy("position").collect()
    assert "".join(row.formatted for row in pieces) == template.render([{"role": "assistant", "text": f"t{at} "} for at in range(1000)])[0]
    assert digest_conversations(format_conversations(frame.limit(0))).collect() == []


def render(source, messages=(), **values):
    return Template(source, {"upper": lambda v: str(v).upper()}).render(messages, **values)


def test_template_language():
    assert render("a{{ 'b' + 'c' }}{{ 1 }}{{ none }}")[0] == "abc1"
    assert render("{% if x == 1 %}one{% elif x in 'yz' %}{{ x | upper }}{% else %}-{% endif %}", x="y")[0] == "Y"
    assert render("{% set n = 'q' %}{{ n }}{%- if not missing and (1 < 2 or false) %} ok{% endif %}")[0] == "q ok"
    said = [{"role": "a", "text": "x"}, {"role": "b", "text": "yy"}]
    source = "H{% for m in messages %}{{ loop.index }}{% generation %}{{ m['text'] }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}T"
    assert render(source, said) == ("H1x,2yyT", [(2, 3), (5, 7)])
    compiled = Template(source, {})
    assert "".join(compiled.turn(m, at, 2)[0] for at, m in enumerate(said)) == "H1x,2yyT"


def test_constants_are_folded():
    compiler = _Compiler({"upper": lambda v: str(v).upper()})
    nodes = compiler.fold_block(parse("a{{ 'b' | upper }}{% if 1 == 2 %}x{% elif true %}c{% else %}{{ y }}{% endif %}{{ z or 'w' }}{{ 'k' or z }}"))
    assert [node.kind for node in nodes] == ["const", "emit", "const"] and nodes[0].value == "aBc" and nodes[2].value == "k"


@pytest.mark.parametrize("source", ["{{ }}", "{{ x y }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | nofilter }}", "{% include 'f' %}", "{{ x() }}", "{{ 'open }}"])
def test_what_is_not_in_the_language(source):
    with pytest.raises(TemplateError):
        render(source)


def test_templates_reach_nothing_but_values():
    assert render("{{ x.__class__ }}{{ x['__init__'] }}{{ x.a.b }}", x="text")[0] == ""
