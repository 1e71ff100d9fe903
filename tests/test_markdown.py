"""Hand-written cases for the markdown rules; block rules are checked line by line."""

from __future__ import annotations

import pytest

from doclake.operators import markdown as md


def run(docs_of, value_of, rule, body):
    transform = rule if rule is md.code_blocks or rule is md.normalise else md.apply(rule)
    return value_of(docs_of(body).transform(transform), "text")[0]


CASES = {
    "clean": (md.clean_characters, "a\xa0\xa0b \\(c\\) \\- d\\.  \n\\#x \\##  ", "a b (c) - d.\n#x \\##"),
    "headers": (
        md.headers, "###\n#x\\y\n#\nTitulo corto\ncosas\nDescripción uno\n# z\nAcaba.\n[a]: \"b\" (c)\nESPECIFICACIÓN x",
        "## #\n# xy\n#\n## Titulo corto\ncosas\nDescripción uno\n# z\nAcaba.\n[a]: \"b\" (c)\n# ESPECIFICACIÓN x"),
    "toc": (md.contents_list, "```json\n[1. A](#a)\n\n [B](#b) \n```\nx", "## Contenido\n\n- [1. A](#a)\n- [B](#b)\n\nx"),
    "toc cut by text": (md.contents_list, "```json\n[A](#a)\ntext\n```\n", "## Contenido\n\n- [A](#a)\n\ntext\n```\n"),
    "toc needs two more lines": (md.contents_list, "x\n```json\n[A](#a)", "x\n```json\n[A](#a)"),
    "merge": (
        md.merge_fences, '```json\n{"a":1}\n```\n\n```json\n{"b":2}\n```\n\nafter', '```json\n{"a":1}\n{"b":2}\n```\nafter'),
    "merge not across brackets": (
        md.merge_fences, "```json\n{1}\n```\n```json\nno: 1\n```\nx", "```json\n{1}\n```\n```json\nno: 1\n```\nx"),
    "merge not across types": (
        md.merge_fences, "```yaml\na: 1\n```\n\n```json\n{1}\n```\n\n\nx", "```yaml\na: 1\n```\n```json\n{1}\n```\nx"),
    "links are not merged": (
        md.merge_fences, "```json\n[a](#a)\n```\n```json\n[b](#b)\n```", "```json\n[a](#a)\n```\n```json\n[b](#b)\n```"),
    "simple fence goes": (md.merge_fences, "```yaml\nplain words\n```\nend", "plain words\nend"),
    "empty fence stays": (md.merge_fences, "```json\n```\n\nz", "```json\n```\n\nz"),
    "unclosed fence is closed": (md.merge_fences, "```json\n{\n}", "```json\n{\n}\n```"),
    "short tail stays": (md.merge_fences, "z\n```json\n{x", "z\n```json\n{x"),
    "text table": (
        md.text_tables, "__A__ __B__\n*1* *2*\nx | y | z\n\nafter\n*h1* *h2*\n*a*   b\n*c*\n__Q__ __R__\nno",
        "| A | B |\n|---|---|\n| 1 | 2 |\n| x | y |\n\nafter\n| h1 | h2 |\n|---|---|\n| *a* | b |\n\n*c*\n__Q__ __R__\nno"),
    "text table pads": (md.text_tables, "__A__ __B__ __C__\n*1* *2*", "| A | B | C |\n|---|---|---|\n| 1 | 2 |  |\n"),
    "pipe table": (
        md.pipe_tables, "| a | b |\n|1|\\*2|\n\nx\n|only|one|row\n\na|b\n| c | d |\n|---|---|\n| e |f|",
        "| a | b |\n| --- | --- |\n| 1 | *2 |\nx\n|only|one|row\n\na|b\n| c | d |\n| --- | --- |\n| e | f |"),
    "open pipe table": (md.pipe_tables, "aa|bb|cc\n1|2|3", "aa | bb | cc\n| --- | --- | --- |\n1 | 2 | 3"),
    "lists": (md.lists, "1\\. uno\n  • dos\n·tres\n- cuatro\n * n", "1. uno\n  - dos\n- tres\n- cuatro\n * n"),
    "links": (
        md.links, "see http://a.com) and (http://b.com) [x] (y) https://c.d/e f",
        "see [http://a.co](http://a.co)m) and (http://b.com) [x](y) [https://c.d/e](https://c.d/e) f"),
    "escapes": (md.escapes, "# a\\#b\nc\\#d e\\@f\\.g \\:\nhttp\\:\\/\\/x", "# a\\#b\nc#d e@f.g \\:\nhttp://x"),
    "final": (md.final_format, "a\n\n\n\nb\n\nc \n\n", "a\n\nb\n\nc"),
    "code": (
        md.code_blocks, '{"a": 1,\n"b": 2}\nx y\nNote: hi\nmore\n\nend\n```\n{\n```\nGET /x\nHost: a\n\n<a>',
        '```json\n{"a": 1,\n"b": 2}\n```\nx y\n```yaml\nNote: hi\nmore\n\n```\nend\n```\n{\n```\n```http\nGET /x\nHost: a\n\n```\n```xml\n<a>\n```'),
    "balanced line takes the next": (md.code_blocks, '{"a":1}\nplain\nx', '```json\n{"a":1}\nplain\n```\nx'),
    "unknown single line": (md.code_blocks, 'x\nHEAD /a', 'x\nHEAD /a'),
    "a lone brace is too short to start a block": (md.code_blocks, "{\nx\n}", "{\nx\n}"),
    "no code": (md.code_blocks, "just words\nand more", "just words\nand more"),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(docs_of, value_of, name):
    rule, body, expected = CASES[name]
    assert run(docs_of, value_of, rule, body) == expected


def test_code_block_stops_after_fifty_lines(docs_of, value_of):
    body = "x\n" + "Key: v\n" * 60 + "last"
    got = run(docs_of, value_of, md.code_blocks, body).split("\n")
    assert got[1] == "```yaml" and got[52] == "```" and got[53] == "```yaml" and got[-1] == "```" and len(got) == 66


def test_long_document_crosses_chunks(docs_of, value_of):
    block = '{ "x":\n"a": [1]\n}\nword\n'
    got = run(docs_of, value_of, md.code_blocks, block * 700)
    assert got == '```json\n{ "x":\n"a": [1]\n}\n```\nword\n' * 700


def test_whole_chain(docs_of, value_of):
    body = "#Pedido \\(1\\)\nIntroducción\n\n\n\nver http://e.com/1 fin\n__A__ __B__\n*1* *2*\n\n•x\n"
    assert run(docs_of, value_of, md.normalise, body) == (
        "# Pedido (1)\n# Introducción\n\nver [http://e.com/1](http://e.com/1) fin\n| A | B |\n| --- | --- |\n| 1 | 2 |\n- x")


def test_lint(docs_of):
    body = "| a | b |\n| - |\n\n--- \n####### x\n#y\ntext\n| only\n``` ```"
    got = [(r.line_no, r.issue.split(" ")[0]) for r in md.lint(docs_of(body)).orderBy("line_no", "issue").collect()]
    assert got == [(2, "Inconsistencia"), (5, "Header"), (6, "Falta"), (8, "Tabla"), (9, "Bloque")]
