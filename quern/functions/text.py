"""Line- and span-oriented text functions: Column to Column, all on the JVM's side.

None stays null and empty stays empty unless a function says otherwise. "Lines" are cut at
line feeds; where a source cuts at every Unicode line end, every_line() does so first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.binding import let

#: Line ends besides the line feed that some of the functions honour, in the order they are tried.
LINE_ENDS = "\\r\\n|[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
STRUCT = "%struct\\.[a-zA-Z0-9_]+"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def clean_string(c: Column) -> Column:
    """Stripped; blank becomes null."""
    return F.nullif(stripped(c), F.lit(""))


def lines(c: Column) -> Column:
    """The lines between line feeds, empty ones too."""
    return F.split(c, "\n", -1)


def every_line(c: Column) -> Column:
    """The lines between any line ends; one at the very end ends the last line."""
    return F.split(F.regexp_replace(F.regexp_replace(c, LINE_ENDS, "\n"), "\n\\z", ""), "\n", -1)


def joined(c: Column) -> Column:
    """Lines joined by line feeds."""
    return F.array_join(c, "\n")


def _renumbered(c: Column, prefix: str) -> Column:
    """Every struct name replaced by prefix and its place among the text's distinct names."""
    between = F.split(c, STRUCT, -1)

    def named(found: Column, names: Column) -> Column:
        new = F.transform(found, lambda m: F.concat(F.lit(prefix), (F.array_position(names, m) - 1).cast("string")))
        return F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(F.regexp_extract_all(c, F.lit(f"({STRUCT})")), lambda found: let(F.array_distinct(found), lambda names: named(found, names)))


def normalize_structs(c: Column) -> Column:
    """Struct names numbered by first appearance; a line feed is added at the end."""
    return F.when(c == "", c).otherwise(F.concat(_renumbered(c, "%struct.struct"), F.lit("\n")))


def strip_ir_noise(c: Column) -> Column:
    """Only function bodies and the definitions of named structs and unions, without trailing blanks."""
    body = "[ \\t]*define [^\\n]*(?:\\n(?![ \\t]*\\}[ \\t]*$)[^\\n]*)*+(?:\\n[ \\t]*\\}[ \\t]*$)?"
    named = "[ \\t]*%(?:struct|union)\\.[^\\n]*"
    kept = F.array_join(F.regexp_extract_all(c, F.lit(f"(?m)^((?:{body})|(?:{named}))$")), "\n")
    return F.when(c == "", c).otherwise(F.regexp_replace(kept, "\\s+\\z", ""))


def truncate_ir(c: Column) -> Column:
    """Up to the first line of a lone closing brace after a function's start; all of it where there is none."""
    head = F.regexp_extract(c, "(?s)\\A((?:[^\\n]*\\n)*?[ \\t\\r\\f\\x0B]*define [^\\n]*\\n(?:[^\\n]*\\n)*?[ \\t\\r\\f\\x0B]*\\}[ \\t\\r\\f\\x0B]*)(?:\\n|\\z)", 1)
    return F.coalesce(F.nullif(head, F.lit("")), c)


def extract_marked(c: Column, name: Column) -> Column:
    """The lines from the last BEGIN mark of name, at or before its first END mark, to that; null where either is missing.

    Marks hold BEGIN or END, then FUNCTION-DEF, the name and a blank.
    """
    def cut(rows: Column) -> Column:
        mark = lambda word: F.concat(F.lit(f"{word} FUNCTION-DEF "), name, F.lit(" "))
        places = lambda word: F.filter(F.transform(rows, lambda x, i: F.when(F.contains(x, mark(word)), i)), lambda i: i.isNotNull())
        last = lambda end: F.array_max(F.filter(places("BEGIN"), lambda i: i <= end))
        span = lambda end: let(last(end), lambda begin: F.when(end.isNotNull() & begin.isNotNull(), joined(F.slice(rows, begin + 1, end - begin + 1))))
        return let(F.get(places("END"), F.lit(0)), span)

    return let(every_line(c), cut)


def dropped_lines(c: Column, patterns: Sequence[str], *, every: bool = False) -> Column:
    """Without the lines that begin with a match of any pattern."""
    rows = every_line(c) if every else lines(c)
    return joined(F.filter(rows, lambda x: ~x.rlike("^(?:" + "|".join(patterns) + ")")))


def strip_comments(c: Column, aarch64: Column) -> Column:
    """Each line up to the comment mark (// or #, by architecture), right-trimmed; blank lines go."""
    cut = F.transform(every_line(c), lambda x: F.regexp_replace(F.when(aarch64, F.substring_index(x, "//", 1)).otherwise(F.substring_index(x, "#", 1)), "\\s+$", ""))
    return joined(F.filter(cut, lambda x: x != ""))


#: Directives that are no part of a training sample; call-frame directives stay.
UNWANTED_DIRECTIVES = ("\\s*\\.file\\s+", "\\s*\\.ident\\s+", "\\s*\\.addrsig", "\\s*\\.section\\s+", "\\s*\\.p2align\\s+", "\\s*\\.text\\s*$", "\\s*\\.Lfunc_end\\d+:", "\\s*\\.size\\s+")
#: Lines of synthetic dependencies that clash with standard headers.
CLASHING_DEPS = ("\\s*typedef\\s+int\\s+bool\\s*;", "\\s*#\\s*define\\s+false\\s+0\\s*$", "\\s*#\\s*define\\s+true\\s+1\\s*$")


def drop_directives(c: Column) -> Column:
    """Without the unwanted directives."""
    return dropped_lines(c, UNWANTED_DIRECTIVES, every=True)


def clean_deps(c: Column) -> Column:
    """Without the lines that clash with standard headers."""
    return dropped_lines(c, CLASHING_DEPS)


def normalize_header(c: Column, name: Column, aarch64: Column) -> Column:
    """The .globl/.global and .type lines of name in the form of its architecture."""
    quoted = F.concat(F.lit("\\Q"), name, F.lit("\\E"))
    scope = F.concat(F.lit("^\\s*\\.glob[al]l?\\s+"), quoted)
    kind = F.concat(F.lit("^\\s*\\.type\\s+"), quoted, F.lit("\\s*,\\s*[%@]function"))
    new_scope = F.concat(F.when(aarch64, F.lit(".global ")).otherwise(F.lit(".globl ")), name)
    new_kind = F.concat(F.lit(".type "), name, F.when(aarch64, F.lit(", %function")).otherwise(F.lit(", @function")))
    return joined(F.transform(every_line(c), lambda x: F.when(F.regexp_like(x, scope), new_scope).when(F.regexp_like(x, kind), new_kind).otherwise(x)))


def clean_whitespace(c: Column) -> Column:
    """Right-trimmed lines, none blank, with one line feed at the end (none if nothing is left)."""
    kept = F.filter(F.transform(every_line(c), lambda x: F.regexp_replace(x, "\\s+$", "")), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(joined(kept), F.lit("\n"))).when(c.isNotNull(), F.lit(""))


def sample_form(c: Column, name: Column, aarch64: Column) -> Column:
    """clean_whitespace(normalize_header(drop_directives(strip_comments(c, aarch64)), name, aarch64)) by patterns over the whole text, not line by line."""
    within = lambda p: p.replace("\\s", "[^\\S\\n]")  # white space, but no line feed
    fed = F.regexp_replace(c, LINE_ENDS, "\n")
    out = F.when(aarch64, F.regexp_replace(fed, "//[^\\n]*+", "")).otherwise(F.regexp_replace(fed, "#[^\\n]*+", ""))
    unwanted = "|".join(within(p.removeprefix("\\s*")) for p in UNWANTED_DIRECTIVES)
    for old, new in (("(?<![^\\S\\n])[^\\S\\n]++(?=\\n|\\z)", ""), ("\\A\\n++|\\n(?=\\n|\\z)", ""), (f"(?dm)^[^\\S\\n]*+(?:{unwanted})[^\\n]*+\\n?+", "")):
        out = F.regexp_replace(out, old, new)
    quoted, spaced = F.concat(F.lit("\\Q"), name, F.lit("\\E")), lambda p: F.lit(within(p))
    literal = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    scope = F.concat(spaced("(?dm)^\\s*\\.glob[al]l?\\s+"), quoted, F.lit("[^\\n]*+"))
    kind = F.concat(spaced("(?dm)^\\s*\\.type\\s+"), quoted, spaced("\\s*,\\s*[%@]function[^\\n]*+"))
    own = F.regexp_replace(F.concat(F.when(aarch64, F.lit(".global ")).otherwise(F.lit(".globl ")), literal), "\\s+$", "")
    out = F.regexp_replace(out, scope, own)
    out = F.regexp_replace(out, kind, F.concat(F.lit(".type "), literal, F.when(aarch64, F.lit(", %function")).otherwise(F.lit(", @function"))))
    out = F.regexp_replace(out, "\\n\\z", "")
    return let(out, lambda t: F.when(t != "", F.concat(t, F.lit("\n"))).otherwise(t))


#: What speaks for either architecture, and how many lines are looked at.
AARCH64_OPS = "(?i)^\\s+(sub|add|str|ldr|ldrsw|subs|mov|b\\.|b\\s|bl\\s|ret|stp|ldp|adrp|cmp|cbz|cbnz|tbnz|tbz|mrs|msr)\\b"
AARCH64_REGISTERS = "\\b(x[0-9]|x[12][0-9]|x30|w[0-9]|w[12][0-9]|w30|sp|xzr|wzr)\\b"
X86_REGISTERS = "\\b(%[re]?[abcd]x|%[re]?[sd]i|%[re]?[sb]p|%r[0-9]+|%[re]?ip)\\b"
LOOKED_AT = 50


def detect_aarch64(c: Column) -> Column:
    """True if the first 50 lines look more like AArch64 than x86; ties are x86."""
    head = F.slice(every_line(F.substring_index(c, "\n", LOOKED_AT)), 1, LOOKED_AT)
    one = lambda test: test.cast("int")

    def arm(x: Column) -> Column:
        return one(x.rlike(AARCH64_OPS)) + one(x.rlike(AARCH64_REGISTERS)) + one(x.rlike("^\\s*//|//\\s*+\\z"))

    def x86(x: Column) -> Column:
        return one(F.contains(x, F.lit("%")) & x.rlike(X86_REGISTERS)) + one(x.rlike("^\\s*#(?!include)"))

    score = lambda f: F.aggregate(F.transform(head, f), F.lit(0), lambda a, b: a + b)
    return score(arm) > score(x86)


def split_function(c: Column) -> Column:
    """struct(header, body, footer: arrays of lines), cut after the first .cfi_startproc and before the next .cfi_endproc; all body without a start."""
    def cut(rows: Column) -> Column:
        at = lambda word: F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(f"^\\s*\\.cfi_{word}"), i)), lambda i: i.isNotNull())

        def parts(start: Column) -> Column:
            head = F.coalesce(start + 1, F.lit(0))
            stop = F.coalesce(F.array_min(F.filter(at("endproc"), lambda i: i > start)), F.size(rows))
            return F.struct(F.slice(rows, F.lit(1), head).alias("header"), F.slice(rows, head + 1, stop - head).alias("body"), F.slice(rows, stop + 1, F.size(rows) - stop).alias("footer"))

        return let(F.get(at("startproc"), F.lit(0)), parts)

    return let(lines(c), cut)


#: Lines of a module that are no code, and inline references to metadata.
NO_CODE = "^(?:;|source_filename|target datalayout|target triple|attributes|!)"
METADATA_REFERENCE = ",?\\s*![a-zA-Z0-9]+(\\s+![0-9]+)?"


def normalize_ir(c: Column) -> Column:
    """Trimmed lines without comments, module metadata, inline metadata and attribute groups; structs numbered. Null is empty."""
    within = lambda p: p.replace("\\s", "[^\\S\\n]")  # white space, but no line feed
    out = F.regexp_replace(c, LINE_ENDS, "\n")
    for old, new in ((within(f"(?m)^\\s*{NO_CODE[1:]}.*$"), ""), (within(METADATA_REFERENCE), ""), ("#\\d+", ""), (within("(?m)^\\s+|\\s+$"), ""), ("\\n{2,}", "\n"), ("\\A\\n|\\n\\z", "")):
        out = F.regexp_replace(out, old, new)
    return F.coalesce(let(out, lambda t: F.when(F.contains(t, F.lit("%struct.")), _renumbered(t, "%struct.struct")).otherwise(t)), F.lit(""))


def tokens(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, "\\s+"), lambda t: t != "")


def filtered_module(c: Column) -> Column:
    """A module's text without empty, comment, header, attribute and metadata lines, nor references to the last two."""
    kept = joined(F.filter(every_line(c), lambda x: (x != "") & ~x.rlike(NO_CODE)))
    return F.regexp_replace(F.regexp_replace(kept, "#\\S+", ""), ",?\\s*![a-zA-Z0-9]+", "")


#: What decoded model output has replaced, before and after line marks are taken out, in order.
DECODED = (("<eol> ", "\n"), ("<eol>", "\n"), ("<tab> ", "\t"), ("<tab>", "\t"), ("<mask:0>", ""), ("<pad>", ""), ("<s>", ""), ("</s>", ""))
DECODED_AFTER = (("0x ", "0x"), (" #", ""), ("return", "return "), ("return  ", "return "), ("static", ""), ("inline", ""))


def detokenized(c: Column) -> Column:
    """Decoded model output as text: markers, special tokens and line marks taken out, in a fixed order."""
    for old, new in DECODED:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "# (/\\w+)*", "")
    for old, new in DECODED_AFTER:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.replace(F.regexp_replace(c, "# (/\\w+)*", ""), F.lit("__attribute__((used))"), F.lit(""))


def name_from_head(c: Column) -> Column:
    """A C function's name from its head: the last word before the last but one opening parenthesis' text ends."""
    return F.replace(F.element_at(tokens(F.try_element_at(F.split(c, "\\("), F.lit(-2))), -1), F.lit("*"), F.lit(""))


#: Headers, type stand-ins and frames of a translation unit.
INCLUDES = ("stdlib", "string", "stdio", "math", "stdint", "stdbool", "limits", "float", "ctype", "assert")
WIDE_FLOATS = ("_Float64", "_Float128", "_Float32x", "_Float64x")
DEPS_BEGIN, DEPS_END, EMPTY_MAIN = "/* --- ExeBench synth_deps --- */", "/* --- end synth_deps --- */", "int main(void) { return 0; }"


def translation_unit(func_def: Column, deps: Column) -> Column:
    """A C file that compiles by itself: headers, stand-ins, cleaned dependencies, the function and, if it lacks one, a main."""
    head = "\n".join([*(f"#include <{h}.h>" for h in INCLUDES), "", *(x for t in WIDE_FLOATS for x in (f"#ifndef {t}", f"  #define {t} double", "#endif")), ""])
    definition = F.regexp_replace(F.regexp_replace(func_def, "__attribute__\\s*\\(\\s*\\(\\s*used\\s*\\)\\s*\\)\\s*", ""), "\\bstatic\\s+inline\\b", "")
    cleaned = clean_deps(deps)
    framed = F.when(F.coalesce(stripped(cleaned), F.lit("")) != "", F.concat(F.lit(f"{DEPS_BEGIN}\n"), cleaned, F.lit(f"\n{DEPS_END}\n\n"))).otherwise(F.lit(""))
    main = F.when(func_def.rlike("\\b(?:int|void)\\s+main\\s*\\("), F.lit("")).otherwise(F.lit(f"\n\n{EMPTY_MAIN}"))
    return F.concat(F.lit(head + "\n"), framed, definition, main)


def without_main(c: Column) -> Column:
    """C text up to its main function."""
    return F.regexp_replace(c, "(?s)\\n?[ \\t]*int\\s+main\\s*\\(.*\\z", "")
