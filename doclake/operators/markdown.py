"""Markdown clean-up of a corpus (``m*``): text → text, row-local, built-in functions only.

Rules about lines and blocks of lines (headers, contents lists, fences, tables, code) let one regular expression cut the
text into blocks and, as one part each, the runs of lines between them; scanning left to right, a match consumes its lines
exactly like a reader would, and only the blocks are looked at line by line. The quantifiers over lines are possessive, so
they need no stack. The lint rule gives every line a one-letter flag instead and cuts the flagged lines. Only code detection
counts braces, which no regular expression can: it counts them in blocks of JSON, and folds over all lines of a text where
such a block leaves other code or a fence behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.functions.frames import let

LINE = r"[^\n]*+\n"
#: white space within a line, a character that is none, and a line of white space alone
GAP, SOLID = rf"[[^!-~\n]&&{tx.WS}]", tx.NOT_SPACE
BLANK = rf"{GAP}*+\n"
_WORD = r"[\p{L}\p{N}_]"


def _regex(pattern: str) -> str:
    """A fixed pattern in its Unicode meaning, ``.`` matching everything within one line."""
    pattern = pattern.replace(r"[-\w]", r"[-\p{L}\p{N}_]").replace(r"[^\s<>\)]", rf"[^{tx._WS_BODY}<>\)]")
    return "(?s)" + tx.java_regex(pattern)


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of a text, not overlapping."""
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def flagged(lines: Column, flag: Callable[[Column], Column]) -> Column:
    """Lines with a flag letter in front, each ended by a newline."""
    return F.concat(tx.joined(F.transform(lines, lambda x: F.concat(flag(x), x))), F.lit("\n"))


def blocks(flagged_text: Column, block: str) -> Column:
    """Cut flagged text into blocks that match ``block`` and single lines for the rest."""
    return F.regexp_extract_all(flagged_text, F.lit(f"{block}|{LINE}"), F.lit(0))


def parts_of(text: Column, block: str, start: str) -> Column:
    """Cut a text into blocks that match ``block``, runs of lines that do not begin like ``start``, and single lines for
    the rest. Each part ends with a newline."""
    return F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(f"{block}|(?:(?!{start}){LINE})++|{LINE}"), F.lit(0))


def begins(part: Column, start: str) -> Column:
    return part.rlike(f"^(?:{start})")


def part_lines(part: Column) -> Column:
    """Lines of a part."""
    return tx.lines_of(F.substr(part, F.lit(1), F.char_length(part) - 1))


def block_lines(block: Column) -> Column:
    """Lines of a block without their flags."""
    return F.transform(F.split(F.rtrim(block, F.lit("\n")), "\n", -1), lambda x: F.substr(x, F.lit(2)))


def unflagged(line: Column) -> Column:
    return F.substr(line, F.lit(2))


def glued(parts: Column) -> Column:
    """Text of parts that each end with a newline; the last newline goes."""
    return let(F.array_join(parts, ""), lambda whole: F.substr(whole, F.lit(1), F.char_length(whole) - 1))


def tail(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.size(items))


def is_block(part: Column) -> Column:
    """Whether a part has more than one line."""
    return F.locate("\n", part) < F.char_length(part)


def where(test: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``rule`` for the texts that pass a cheap test; the others cannot change and are left alone."""
    return lambda text: F.when(test(text), rule(text)).otherwise(text)


def has(*words: str) -> Callable[[Column], Column]:
    return lambda text: tx.contains_any(text, words)


def per_line(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: tx.joined(F.transform(tx.lines_of(text), rule))


# ---- m1, m2 ----------------------------------------------------------------------------------


def clean_characters(text: Column) -> Column:
    """m1: hard spaces, needless escapes, repeated blanks, line ends."""
    soft = F.replace(text, F.lit("\xa0"), F.lit(" "))
    # without a pair of backslashes no rule makes work for the next one, so all go in one pass
    c = F.regexp_replace(soft, rf"\\([().,;:{{}}\[\]]|[-.]|#(?![#{tx._WS_BODY}]))", "$1")
    by_rule = F.regexp_replace(soft, r"\\([().,;:{}\[\]])", "$1")
    by_rule = F.regexp_replace(by_rule, r"\\([-.])", "$1")
    by_rule = F.regexp_replace(by_rule, rf"\\#(?![#{tx._WS_BODY}])", "#")
    c = F.when(~has("\\")(text), soft).when(~has("\\\\")(text), c).otherwise(by_rule)
    c = F.regexp_replace(c, r"[ \t](?:(?<=\t)|[ \t])[ \t]*+", " ")  # one blank is left alone
    return F.regexp_replace(c, "(?dm) $", "")


def headers(text: Column) -> Column:
    """m2: tidy header lines, and promote short capitalised lines that are not followed by a header."""
    header = _regex(r"^(#+)\s*(.+)")

    def rule(x: Column, s: Column, following: Column) -> Column:
        title = F.replace(tx.strip(F.regexp_extract(s, header, 2)), F.lit("\\"), F.lit(""))
        tidy = F.when(s.rlike(header), F.concat(F.regexp_extract(s, header, 1), F.lit(" "), title)).otherwise(x)
        promoted = (
            s.rlike(r"^\p{IsUppercase}") & (F.char_length(s) <= 80) & ~F.endswith(s, F.lit("."))
            & (F.regexp_count(s, F.lit(fixed.PROMOTE_SPECIALS)) <= 2) & ~begins(following, f"{GAP}*+#")
        )
        level = F.when(s.rlike("(?iu)" + "|".join(fixed.TITLE_LEVEL_ONE)), "# ").otherwise("## ")
        return F.when(F.startswith(s, F.lit("#")), tidy).when(promoted, F.concat(level, s)).otherwise(x)

    start = rf"{GAP}*+[#\p{{IsUppercase}}]"

    def each(parts: Column) -> Column:
        def rewrite(part: Column, i: Column) -> Column:
            x, following = F.rtrim(part, F.lit("\n")), F.coalesce(F.get(parts, i + 1), F.lit(""))
            line = let(tx.strip(x), lambda s: rule(x, s, following))
            return F.when(begins(part, start), F.concat(line, F.lit("\n"))).otherwise(part)

        return glued(F.transform(parts, rewrite))

    return let(parts_of(text, start + LINE, start), each)


# ---- m3, m4: fenced blocks -------------------------------------------------------------------


_JSON_FENCE = rf"{GAP}*+```json"
_TOC_LINE = rf"{GAP}*+\[[^\n]*\]\(#[^\n]*\){GAP}*+\n"


def _contents_list(text: Column) -> Column:
    """m3: a ``json`` fence that starts with ``[x](#a)`` entries becomes a contents list."""
    toc = rf"{_JSON_FENCE}{LINE}(?={_TOC_LINE}(?!\z))(?:{_TOC_LINE}|{BLANK})*+(?:{GAP}*+```{LINE})?+"

    def rewrite(part: Column) -> Column:
        entries = F.filter(F.transform(tail(part_lines(part)), tx.strip), lambda s: F.startswith(s, F.lit("[")))
        shown = F.transform(entries, lambda s: F.concat(F.lit("- "), s, F.lit("\n")))
        return F.when(
            is_block(part) & begins(part, _JSON_FENCE),
            F.concat(F.lit(fixed.TOC_TITLE + "\n\n"), F.array_join(shown, ""), F.lit("\n")),
        ).otherwise(part)

    return glued(F.transform(parts_of(text, toc, _JSON_FENCE), rewrite))


contents_list = where(has("```json"), _contents_list)


def _merge_fences(text: Column) -> Column:
    """m4: consecutive ``json``/``yaml`` fences of one type become one; a fence around one plain line goes.

    A chain of fences separated by blank lines is one block; a fold over its fences decides which belong together.
    """
    opening, closing_line = rf"{GAP}*+```(?:json|yaml)", rf"{GAP}*+```{BLANK}"
    fence = rf"{opening}{LINE}(?:(?!{closing_line}){LINE})*+(?:{closing_line})?+(?:{BLANK})*+"
    parts = parts_of(text, f"(?:{fence})++", opening)

    def parsed(one: Column) -> Column:
        """A fence as its type, content lines, original text and number of lines."""
        def fields(rows: Column) -> Column:
            closing = F.array_position(F.transform(rows, lambda x: tx.strip(x) == "```"), True)
            return F.struct(
                F.replace(tx.strip(F.get(rows, F.lit(0))), F.lit("```"), F.lit("")).alias("type"),
                F.when(closing > 0, F.slice(rows, 2, (closing - 2).cast("int"))).otherwise(tail(rows)).alias("content"),
                one.alias("raw"), F.size(rows).alias("n"),
            )

        return let(part_lines(one), fields)

    def brackets(lines: Column) -> Column:
        return F.exists(F.slice(lines, 1, 2), lambda x: x.rlike(r"[{\[]"))

    def belongs(state: Column, nxt: Column) -> Column:
        head, add = state["head"], nxt["content"]
        filled = F.filter(head, lambda x: ~tx.is_blank(x))
        links = F.forall(filled, lambda x: F.startswith(tx.strip(x), F.lit("[")) & F.contains(x, F.lit("](")))
        return (
            (state["type"] == nxt["type"]) & (F.size(head) > 0) & (F.size(add) > 0) & ~links & (brackets(head) == brackets(add))
        )

    def group_codes(fences: Column) -> Column:
        """``s`` for each fence that starts a group, ``c`` for one that joins it. The first three lines of a group
        decide, so the state stays small however long the chain is."""
        def step(state: Column, nxt: Column) -> Column:
            top = F.slice(nxt["content"], 1, 3)
            joins = F.struct(
                state["type"].alias("type"), F.slice(F.concat(state["head"], top), 1, 3).alias("head"),
                F.concat(state["codes"], F.lit("c")).alias("codes"),
            )
            starts = F.struct(nxt["type"].alias("type"), top.alias("head"), F.concat(state["codes"], F.lit("s")).alias("codes"))
            return F.when(belongs(state, nxt), joins).otherwise(starts)

        start = F.struct(F.lit("").alias("type"), F.array().cast("array<string>").alias("head"), F.lit("").alias("codes"))
        return F.split(F.aggregate(fences, start, step, lambda state: state["codes"]), "")

    def grouped(fences: Column) -> Column:
        """Fences → groups with their joint content."""
        def cut(codes: Column) -> Column:
            at = F.filter(F.transform(codes, lambda c, i: F.when(c == "s", i)), lambda i: i.isNotNull())

            def group(starts: Column) -> Column:
                def one(i: Column, k: Column) -> Column:
                    n = F.coalesce(F.get(starts, k + 1), F.size(fences)) - i
                    return let(F.slice(fences, i + 1, n), lambda members: F.struct(
                        F.get(members, F.lit(0))["type"].alias("type"), F.flatten(F.transform(members, lambda m: m["content"])).alias("content"),
                        F.get(members, F.lit(0))["raw"].alias("raw"), F.get(members, F.lit(0))["n"].alias("n"),
                    ))

                return F.transform(starts, one)

            return let(at, group)

        return let(group_codes(fences), cut)

    def shown(group: Column, at_end: Column) -> Column:
        content = group["content"]
        only = F.get(content, F.lit(0))
        simple = (
            (F.size(content) == 1) & (F.char_length(tx.strip(only)) < fixed.SIMPLE_BLOCK_LENGTH)
            & ~tx.contains_any(only, fixed.COMPLEX_CODE)
        )
        # a fence without content, or cut off by the end of the text, is alone in its group
        as_is = (F.size(content) == 0) | (at_end & (group["n"] < 3))
        fenced = F.concat(F.lit("```"), group["type"], F.lit("\n"), tx.joined(content), F.lit("\n```\n"))
        return F.when(as_is, group["raw"]).when(simple, F.concat(only, F.lit("\n"))).otherwise(fenced)

    def rewrite(part: Column, last_part: Column) -> Column:
        texts = let(
            let(F.transform(F.regexp_extract_all(part, F.lit(fence), F.lit(0)), parsed), grouped),
            lambda groups: F.array_join(F.transform(groups, lambda g, k: shown(g, last_part & (k == F.size(groups) - 1))), ""),
        )
        return F.when(begins(part, opening), texts).otherwise(part)

    return glued(let(parts, lambda ps: F.transform(ps, lambda part, i: rewrite(part, i == F.size(ps) - 1))))


merge_fences = where(has("```json", "```yaml"), _merge_fences)


# ---- m5, m6: tables --------------------------------------------------------------------------


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, tx.strip), lambda x: x != "")


def table_headers(s: Column) -> Column:
    """Column names of a text-table header line (stripped); fewer than two if it is none."""
    pick = lambda p: _filled(F.regexp_extract_all(s, F.lit(p), F.lit(1)))
    names = F.when(F.contains(s, F.lit("__")), pick(fixed.UNDERLINED)).when(count_of(s, "*") >= 4, pick(fixed.STARRED))
    looks = (F.contains(s, F.lit("__")) | F.contains(s, F.lit("*"))) & tx.any_of(s.rlike(p) for p in fixed.TABLE_HEADERS)
    return F.when(looks, let(names, lambda v: F.when(F.size(v) >= 2, v)))


def row_values(s: Column) -> Column:
    """Cells of a text-table row (stripped), null if it is none; the first way that gives two cells counts."""
    wide, double = rf"{tx.SPACE}{{3,}}|\t+", rf"{tx.SPACE}{{2,}}"
    ways = [  # the cheap test in front keeps the costly split to the lines that need it
        (s.rlike(r"(?s)\*[^*]+\*.*?\*[^*]+\*"), F.transform(F.regexp_extract_all(s, F.lit(fixed.STARRED), F.lit(1)), tx.strip)),
        (s.rlike(wide), _filled(F.split(s, wide))),
        (F.contains(s, F.lit("|")), _filled(F.split(s, r"\|"))),
        (F.contains(s, F.lit("  ")), _filled(F.split(s, double))),
    ]
    two = lambda w: let(w, lambda v: F.when(F.size(v) >= 2, v))
    return F.when(s != "", F.coalesce(*[F.when(test, two(w)) for test, w in ways]))


def row_of(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))


def _two_names(name: str, blank: str) -> str:
    """A line in which two matches of ``name`` are not ``blank``, as a reader finds them from left to right."""
    another = rf"(?:(?:(?!{name})[^\n])*+{blank})*+(?:(?!{name})[^\n])*+{name}"
    return another * 2


_UNDERLINED, _STARRED = r"__[^_\n]+__", r"\*[^*\n]+\*"
#: the lines that ``table_headers`` finds names in
HEADER_START = (
    rf"(?=[^_*\n]*+[_*])(?=[^\n]*?(?:{'|'.join(fixed.TABLE_HEADERS)}))".replace("[^_]", r"[^_\n]").replace("[^*]", r"[^*\n]")
    + rf"(?={_two_names(_UNDERLINED, f'__{GAP}+__')}|(?![^\n]*__){_two_names(_STARRED, rf'[*]{GAP}+[*]')})"
)
#: the lines that ``row_values`` finds cells in: two starred texts, two words with a wide gap, or two texts at a pipe
ROW_START = (
    rf"(?=(?:(?:(?!{_STARRED})[^\n])*+{_STARRED}){{2}}"
    rf"|{GAP}*+{SOLID}++(?:(?!{GAP}?\t|  |{GAP}{{3}}){GAP}{{1,2}}+{SOLID}++)*+{GAP}++{SOLID}"
    rf"|[|{GAP}]*+[^|\n]++\|[|{GAP}]*+[^\n])"
)


def _text_tables(text: Column) -> Column:
    """m5: a header line of marked names and the rows that follow become a pipe table."""
    table = rf"{HEADER_START}{LINE}(?:{ROW_START}{LINE})++(?:{BLANK})?+"
    parts = parts_of(text, table, HEADER_START)

    def converted(rows: Column, names: Column) -> Column:
        n = F.size(names)
        padded = lambda cells: F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), F.lit(1), n)
        body = F.transform(tail(rows), lambda x: row_of(padded(row_values(x))))
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), n), F.lit("\n"))
        return F.concat(row_of(names), rule, F.array_join(body, ""), F.lit("\n"))

    def rewrite(part: Column) -> Column:
        rows = _filled(part_lines(part))
        table_text = let(rows, lambda r: let(table_headers(F.get(r, F.lit(0))), lambda names: converted(r, names)))
        return F.when(is_block(part) & begins(part, HEADER_START), table_text).otherwise(part)

    return glued(F.transform(parts, rewrite))


text_tables = where(lambda text: tx.any_of(text.rlike(p) for p in fixed.TABLE_HEADERS), _text_tables)


def _pipe_tables(text: Column) -> Column:
    """m6: pipe tables get a separator row and evenly spaced pipes; the blank line after them goes."""
    start = rf"(?=[^|\n]*+\|[^|\n]*+\|)(?={GAP}*+[^\n]{{5,}}{SOLID})"
    parts = parts_of(text, rf"{start}{LINE}(?:[^|\n]*+\|{LINE})++(?:{BLANK})?+", start)

    def tidy(rows: Column) -> Column:
        c = F.regexp_replace(tx.joined(rows), r"\\([*_])", "$1")
        c = F.regexp_replace(c, rf"{GAP}(?:(?<! )|{GAP}){GAP}*+", " ")  # one blank is left alone
        return F.concat(F.regexp_replace(F.regexp_replace(c, r" ?\| ?", " | "), "(?dm)^ | $", ""), F.lit("\n"))

    def converted(rows: Column) -> Column:
        first = tx.strip(F.get(rows, F.lit(0)))
        closed = F.startswith(first, F.lit("|")) & F.endswith(first, F.lit("|"))
        columns = count_of(first, "|") + F.when(closed, -1).otherwise(1)
        ruled = F.exists(F.slice(rows, 1, 3), lambda x: tx.contains_any(x, fixed.SEPARATOR_MARKS))
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), columns.cast("int")))
        all_rows = F.when(ruled, rows).otherwise(F.concat(F.slice(rows, 1, 1), F.array(rule), tail(rows)))
        return tidy(all_rows)

    def rewrite(part: Column) -> Column:
        rows = F.filter(part_lines(part), lambda x: F.contains(x, F.lit("|")))
        return F.when(is_block(part) & begins(part, start), let(rows, converted)).otherwise(part)

    return glued(F.transform(parts, rewrite))


pipe_tables = where(has("|"), _pipe_tables)


# ---- m7, m8 ----------------------------------------------------------------------------------


def list_line(x: Column) -> Column:
    """m7: escaped numbers and bullet signs at the start of a line."""
    s = tx.strip(x)
    numbered, bullet = _regex(r"^(\d+)\\\.\s*(.+)"), _regex(r"^[•·]\s*")
    indent = F.char_length(x) - F.char_length(F.ltrim(x, F.lit(tx.WHITESPACE)))
    return (
        F.when(s.rlike(numbered), F.concat(F.regexp_extract(s, numbered, 1), F.lit(". "), F.regexp_extract(s, numbered, 2)))
        .when(s.rlike(bullet), F.concat(F.repeat(F.lit(" "), indent), F.lit("- "), F.regexp_replace(s, bullet, "")))
        .otherwise(x)
    )


def _lists(text: Column) -> Column:
    """``list_line`` for all lines at once; an indent of other white space than blanks is left to it."""
    rest = rf"{GAP}*+({SOLID}(?:[^\n]*{SOLID})?+){GAP}*+$"
    numbered = F.when(
        has("\\.")(text), F.regexp_replace(text, rf"(?dm)^{GAP}*+(\p{{Nd}}++)\\\.{rest}", "$1. $2")
    ).otherwise(text)
    bullets = F.regexp_replace(numbered, rf"(?dm)^( *+)[•·](?:{rest}|{GAP}*+$)", "$1- $2")
    return F.when(text.rlike(rf"(?dm)^ *+(?! ){GAP}++[•·]"), per_line(list_line)(text)).otherwise(bullets)


lists = where(has("•", "·", "\\."), _lists)


def links(text: Column) -> Column:
    """m8: bare URLs become links, and no gap between the two parts of a link."""
    # the first letter is told before what stands in front of it
    bare = _regex(fixed.BARE_URL.replace(r"(?<![\[\(])(h", r"(h(?<![\[\(]h)"))
    linked = F.when(F.contains(text, F.lit("http")), F.regexp_replace(text, bare, "[$1]($1)")).otherwise(text)
    return F.regexp_replace(linked, _regex(fixed.SPACED_LINK), "[$1]($2)")


# ---- m9: code --------------------------------------------------------------------------------

CHUNK = 1024


def code_features(x: Column) -> Column:
    """What the code scan needs to know of a line."""
    return let(tx.strip(x), _stripped_features)


def _stripped_features(s: Column) -> Column:
    starts = (F.char_length(s) >= 2) & (
        s.rlike("|".join(_regex(p) for p in fixed.CODE_STARTS))
        | (F.contains(s, F.lit(":")) & (count_of(s, '"') >= 2))
    )
    return F.struct(
        F.startswith(s, F.lit("```")).alias("fence"), F.when(starts, language_letter(s)).alias("starts"), (s == "").alias("blank"),
        balance(s, "{", "}").alias("braces"), balance(s, "[", "]").alias("brackets"),
    )


def language_letter(s: Column) -> Column:
    """Language of the code that starts with a line (stripped)."""
    return (
        F.when(s.rlike(r"^[{\[]"), "j").when(F.startswith(s, F.lit("<")), "m").when(s.rlike(_regex(fixed.CODE_HTTP)), "h")
        .when(F.contains(s, F.lit(":")) & ~F.contains(s, F.lit("=")) & ~F.startswith(s, F.lit("http")), "y").otherwise("o")
    )


def balance(s: Column, opening: str, closing: str) -> Column:
    count = count_of(s, opening) - count_of(s, closing)
    return F.when(tx.contains_any(s, [opening, closing]), count).otherwise(F.lit(0).cast("bigint"))


LANGUAGES = {"j": "json", "m": "xml", "h": "http", "y": "yaml", "o": ""}


def code_codes(features: Column) -> Column:
    """One letter per line: language letter at a block start, ``c`` inside, ``z`` at its last line, ``n`` elsewhere.

    The state is a handful of numbers. Letters are gathered per chunk of lines and the chunks joined afterwards, so
    that a document of a million lines does not copy a growing text a million times.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit(False).alias("fenced"), F.lit(0).alias("left"), F.lit(False).alias("json"),
        zero.alias("braces"), zero.alias("brackets"), F.lit("").alias("codes"),
    )

    def step(st: Column, x: Column) -> Column:
        inside = st["left"] > 0
        toggles = ~inside & x["fence"]
        opens = ~inside & ~x["fence"] & ~st["fenced"] & x["starts"].isNotNull()
        json = F.when(opens, x["starts"] == "j").otherwise(st["json"])
        braces = F.when(opens, x["braces"]).otherwise(st["braces"] + x["braces"])
        brackets = F.when(opens, x["brackets"]).otherwise(st["brackets"] + x["brackets"])
        ends = inside & (x["blank"] | (st["left"] == 1) | (st["json"] & (braces <= 0) & (brackets <= 0)))
        code = F.when(opens, x["starts"]).when(ends, "z").when(inside, "c").otherwise("n")
        left = F.when(opens, fixed.CODE_BLOCK_LINES - 1).when(ends, 0).when(inside, st["left"] - 1).otherwise(0)
        return F.struct(
            F.when(toggles, ~st["fenced"]).otherwise(st["fenced"]).alias("fenced"), left.alias("left"), json.alias("json"),
            braces.alias("braces"), brackets.alias("brackets"), F.concat(st["codes"], code).alias("codes"),
        )

    def cleared(st: Column) -> Column:
        return F.struct(*[st[n].alias(n) for n in ["fenced", "left", "json", "braces", "brackets"]], F.lit("").alias("codes"))

    def chunk_step(st: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(features, at, CHUNK), cleared(st), step)
        return F.aggregate(
            F.array(inner), st,
            lambda old, new: F.struct(
                *[new[n].alias(n) for n in ["fenced", "left", "json", "braces", "brackets"]],
                F.concat(old["codes"], new["codes"]).alias("codes"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.size(features), F.lit(CHUNK)), start, chunk_step, lambda st: st["codes"])


def code_blocks_from(lines: Column, codes: Column) -> Column:
    """Fence the blocks that the letters mark."""
    last = F.size(lines) - 1

    def rule(x: Column, i: Column) -> Column:
        code = F.get(codes, i)
        opening = None
        for letter, name in LANGUAGES.items():
            arm = F.concat(F.lit(f"```{name}\n"), x)
            opening = F.when(code == letter, arm) if opening is None else opening.when(code == letter, arm)
        at_end = (i == last) & code.isin("c", *LANGUAGES)
        alone = (code == "o") & (i == last)  # one line of no known language stays as it is
        return F.when(alone, x).otherwise(
            F.concat(opening.otherwise(x), F.when((code == "z") | at_end, "\n```").otherwise(""))
        )

    return tx.joined(F.transform(lines, rule))


#: the lines that ``code_features`` says code starts in
CODE_START = (
    rf"(?!{GAP}*+```){GAP}*+(?=[^\n]{GAP}*+{SOLID})(?:[{{\[]|<[a-zA-Z][^>\n]*+>|(?:POST|GET|PUT|DELETE|PATCH|HEAD|OPTIONS){GAP}++/"
    rf"|HTTP/[0-9]\.[0-9]|[A-Za-z][-\p{{L}}\p{{N}}_]*+:{GAP}++[^\n]|\"[^\"\n]++\"{GAP}*+:|(?=[^:\n]*+:)[^\"\n]*+\"[^\"\n]*+\")"
)
FENCE_START = rf"{GAP}*+```"


def _coded(text: Column) -> Column:
    """Text with its code fenced; null where a block of JSON ends before lines that hold other code or a fence."""
    fenced = rf"{FENCE_START}{LINE}(?:(?!{FENCE_START}){LINE})*+(?:{FENCE_START}{LINE})?+"
    # a block ends with a blank line, or as long as it may be; JSON ends earlier where its brackets do
    block = rf"{CODE_START}{LINE}(?:(?!{BLANK}){LINE}){{0,{fixed.CODE_BLOCK_LINES - 2}}}+(?:{LINE})?+"
    parts = parts_of(text, f"{fenced}|{block}", f"{FENCE_START}|{CODE_START}")

    def json_lines(rows: Column) -> Column:
        """Number of lines until the brackets are closed, from the second line on."""
        def step(st: Column, x: Column) -> Column:
            braces, brackets = st["braces"] + balance(x, "{", "}"), st["brackets"] + balance(x, "[", "]")
            closed = (st["n"] > 0) & (braces <= 0) & (brackets <= 0)
            more = F.struct(braces.alias("braces"), brackets.alias("brackets"), (st["n"] + 1).alias("n"), closed.alias("closed"))
            return F.when(st["closed"], st).otherwise(more)

        zero = F.lit(0).cast("bigint")
        start = F.struct(zero.alias("braces"), zero.alias("brackets"), F.lit(0).alias("n"), F.lit(False).alias("closed"))
        return F.aggregate(rows, start, step, lambda st: st["n"])

    def shown(letter: Column, rows: Column, n: Column) -> Column:
        name = F.lit("")
        for known, language in LANGUAGES.items():
            name = F.when(letter == known, language).otherwise(name)
        code, rest = F.slice(rows, F.lit(1), n), F.slice(rows, n + 1, F.size(rows))
        follows = F.exists(rest, lambda x: begins(F.concat(x, F.lit("\n")), f"{FENCE_START}|{CODE_START}"))
        return F.when(~follows, F.concat(
            F.lit("```"), name, F.lit("\n"), tx.joined(code), F.lit("\n```\n"), F.array_join(F.transform(rest, lambda x: F.concat(x, F.lit("\n"))), ""),
        ))

    def rewrite(part: Column, last_part: Column) -> Column:
        def block_of(letter: Column) -> Column:
            # one line of no known language at the end stays as it is
            return F.when((letter == "o") & last_part & ~is_block(part), part).otherwise(let(part_lines(part), lambda rows: let(
                F.when(letter == "j", json_lines(rows)).otherwise(F.size(rows)), lambda n: shown(letter, rows, n),
            )))

        first = tx.strip(F.substring_index(part, "\n", 1))
        return F.when(begins(part, CODE_START), let(language_letter(first), block_of)).otherwise(part)

    def whole(ps: Column) -> Column:
        texts = F.transform(ps, lambda part, i: rewrite(part, i == F.size(ps) - 1))
        return let(texts, lambda ts: F.when(~F.exists(ts, lambda x: x.isNull()), glued(ts)))

    return let(parts, whole)


def _coded_by_lines(text: Column) -> Column:
    """``_coded`` of any text, by a fold over its lines."""
    return let(tx.lines_of(text), lambda lines: let(
        F.split(code_codes(F.transform(lines, code_features)), ""), lambda codes: code_blocks_from(lines, codes)
    ))


def code_blocks(docs: DataFrame) -> DataFrame:
    """m9: fence lines that look like JSON, XML, HTTP or headers."""
    return docs.transform(apply(lambda text: F.coalesce(_coded(text), _coded_by_lines(text))))


# ---- m10 to m14 ------------------------------------------------------------------------------


def escape_line(x: Column) -> Column:
    """m10: needless escapes outside headers; colons and slashes only on lines with an address."""
    c = F.regexp_replace(x, r"\\([#.@])", "$1")
    linked = F.contains(x, F.lit("http")) | F.contains(x, F.lit("www."))
    linked_after = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www."))
    return F.when(F.startswith(tx.strip(x), F.lit("#")), x).when(
        linked | linked_after, F.regexp_replace(c, r"\\([:/])", "$1")
    ).otherwise(c)


def _escapes(text: Column) -> Column:
    """``escape_line`` for all lines at once; escaped colons and slashes are left to it."""
    return F.when(has("\\:", "\\/")(text), per_line(escape_line)(text)).otherwise(
        F.regexp_replace(text, rf"(?dm)^({GAP}*+#[^\n]*+)|\\([#.@])", "$1$2")
    )


escapes = where(has("\\"), _escapes)


def final_format(text: Column) -> Column:
    """m11: at most one blank line in a row, none at the end."""
    return F.rtrim(F.regexp_replace(text, "\n\n\n+", "\n\n"), F.lit(tx.WHITESPACE))


def apply(rule: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A text rule as a DataFrame transform."""
    return lambda docs: docs.withColumn("text", rule(F.col("text")))


def normalise(docs: DataFrame) -> DataFrame:
    """m12: all rules in order."""
    return (
        docs.transform(apply(clean_characters)).transform(apply(headers)).transform(apply(contents_list))
        .transform(apply(merge_fences)).transform(apply(text_tables)).transform(apply(pipe_tables))
        .transform(apply(lists)).transform(apply(links)).transform(code_blocks)
        .transform(apply(escapes)).transform(apply(final_format))
    )


def quality(docs: DataFrame) -> DataFrame:
    """m13: words, header lines, tables, and the header block in its short and long form."""
    text = F.col("text")
    counted = docs.select(
        "doc_id", "text", tx.base_name(F.col("file_name")).alias("name"), tx.word_count(text).alias("words"),
        F.size(F.filter(tx.lines_of(text), lambda x: F.startswith(tx.strip(x), F.lit("#")))).cast("bigint").alias("headings"),
        F.floor(count_of(text, "|") / 4).cast("bigint").alias("tables"),
    )
    top = F.concat(F.lit(fixed.DOC_TITLE + "\n- **File:** "), F.col("name"), F.lit("\n- **Content:** ~"), tx.thousands(F.col("words")))
    tail = F.lit("\n\n### 📖 Document Content\n")
    return counted.select(
        "doc_id", "words", "headings", "tables",
        F.concat(top, F.lit(" words processed with premium Mammoth"), tail).alias("basic_header"),
        F.concat(
            top, F.lit(" words, "), F.col("headings").cast("string"), F.lit(" headings, ~"), F.col("tables").cast("string"),
            F.lit(" tables\n- **Processing:** Premium Mammoth converter with advanced post-processing"
                  "\n- **Quality:** High-fidelity markdown with table detection and code formatting"), tail,
        ).alias("full_header"),
    )


def line_issues(text: Column) -> Column:
    """m14: one array of issues per line.

    Lines of plain text end a table, so they cut the document into regions; within a region the first pipe line sets
    the column count.
    """
    def is_row(x: Column) -> Column:
        return F.contains(x, F.lit("|")) & ~F.startswith(tx.strip(x), F.lit("```"))

    def flag(x: Column) -> Column:
        ends = ~F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("---")) & ~tx.is_blank(x)
        return F.when(ends, "x").otherwise("o")

    pipes = lambda x: count_of(x, "|") - count_of(x, "\\|")
    parts = blocks(flagged(tx.lines_of(text), flag), rf"(?:o{LINE})++")

    def issues(x: Column, at: Column, first: Column, columns: Column) -> Column:
        row, after = is_row(x), (first > 0) & (at > first)
        skipped = ~row & after & F.contains(x, F.lit("---"))
        level = F.char_length(F.regexp_extract(x, "^(#*)", 1))
        header = ~skipped & F.startswith(x, F.lit("#"))
        fence = ~skipped & F.startswith(tx.strip(x), F.lit("```")) & (count_of(x, "```") != 1)
        return F.array_compact(F.array(
            F.when(row & after & (pipes(x) != columns) & (pipes(x) > 0), fixed.LINT_COLUMNS),
            F.when(row & (pipes(x) < 2), fixed.LINT_PIPES),
            F.when(header & (level > fixed.MAX_HEADER_LEVEL), F.replace(F.lit(fixed.LINT_LEVEL), F.lit("{level}"), level.cast("string"))),
            F.when(header & (F.char_length(x) > level) & (F.substr(x, level + 1, F.lit(1)) != " "), fixed.LINT_SPACE),
            F.when(fence, fixed.LINT_FENCE),
        ))

    def checked(part: Column) -> Column:
        def region(rows: Column) -> Column:
            at_first = F.array_position(F.transform(rows, is_row), True)
            table = F.struct(at_first.alias("first"), pipes(F.get(rows, (at_first - 1).cast("int"))).alias("columns"))
            return let(table, lambda t: F.transform(rows, lambda x, i: issues(x, i + 1, t["first"], t["columns"])))

        return let(block_lines(part), region)

    return F.flatten(F.transform(parts, checked))


def lint(docs: DataFrame) -> DataFrame:
    """m14: issues as rows."""
    each = docs.select("doc_id", F.posexplode(line_issues(F.col("text"))).alias("p", "issues"))
    return each.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), F.explode("issues").alias("issue"))


def verdict(docs: DataFrame) -> DataFrame:
    """m14: validity of each document."""
    return docs.select("doc_id", "text", F.size(F.flatten(line_issues(F.col("text")))).cast("bigint").alias("n_issues")).select(
        "doc_id", (F.col("n_issues") == 0).alias("valid"), "n_issues",
        F.size(tx.lines_of(F.col("text"))).cast("bigint").alias("total_lines"),
        F.contains("text", F.lit("|")).alias("tables_found"),
    )
