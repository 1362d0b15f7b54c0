"""Queries over whole tables and whole texts, against brute force."""

import re
from collections import defaultdict

from test_functions import bleu

from quern.functions import text
from quern.plans import catalog

SF = "/root/testdata/sf0.001"


def test_events_are_taken_whole(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "value").collect()
    groups = defaultdict(list)
    for e in events:
        groups[e.user_id % 50].append(e.event_id)
    got = {r.seed: (r.n, r.ids) for r in catalog.QUERIES["group_by_seed"](spark, SF).collect()}
    assert got == {k: (len(v), ",".join(map(str, sorted(v)))) for k, v in groups.items()}
    near = {r.event_id: r.near for r in catalog.QUERIES["io_compare"](spark, SF).collect()}
    assert near == {e.event_id: e.value == 0 or e.event_id % 3 < 2 for e in events}


def test_documents_with_other_line_ends_are_taken(spark):
    texts = ["a b", "a\r\nb\r\n\r\nc", "a\rb\x0bc\x0cd", "x\r\n\t.file \"b.c\"\r\ny\x0c.text\x0bz", "", "u\n\t.cfi_def_cfa 4\nv", "u\n\t.cfi_endproc\nv\r\n\t.cfi_startproc\nw", ".cfi_startproc"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    t = lambda name: df
    spans = {r.doc_id: r.t for r in catalog.span_extract(t).collect()}
    dropped = {r.doc_id: r.t for r in catalog.directive_drop(t).collect()}
    split = {r.doc_id: (r.header, r.body, r.footer) for r in catalog.function_split(t).collect()}
    unwanted = re.compile("|".join(text.UNWANTED_DIRECTIVES))
    for i, x in enumerate(texts, 1):
        want = f"/* BEGIN FUNCTION-DEF f{i} */\n{x}\n/* END FUNCTION-DEF f{i} */"
        assert spans[i] == ("\n".join(want.splitlines()) if i % 5 else None)
        assert dropped[i] == "\n".join(y for y in f"{x}\n\t.cfi_endproc".splitlines() if not unwanted.match(y))
        lines = f".globl f\nf:\n\t.cfi_startproc\n{x}\n\t.cfi_endproc\n.size f".split("\n")
        stop = next(k for k, y in enumerate(lines) if k > 2 and y.lstrip().startswith(".cfi_endproc"))
        assert split[i] == tuple("\n".join(x) for x in (lines[:3], lines[3:stop], lines[stop:]))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def tokens(x):
    """13a words of texts without digits, marks or entities other than apostrophes."""
    return x.split()


def test_turns_are_scored_whole(spark):
    pairs = [("où est la forêt de l'été", "ou est la foret de l'ete"), ("naïve é", "naïve è"), ("a b c d 😀 e", "a b c d 😀 e"), ("Größe ist nicht alles hier", "Große ist nicht alles hier")]
    rows = [(i, k, r, x) for i, (u, a) in enumerate(pairs) for k, r, x in ((0, "user", u), (1, "assistant", a))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    t = lambda name: df
    far = [edits(a, u) for u, a in pairs]
    assert {r.conv_id: (r.chars, r.same, r.n_tokens) for r in catalog.pair_metrics_whole(t).collect()} == {i: (far[i], u == a, len(a.split())) for i, (u, a) in enumerate(pairs)}
    assert {r.conv_id: r.edits for r in catalog.token_distance(t).collect()} == {i: edits(a.split(), u.split()) for i, (u, a) in enumerate(pairs)}
    report = {r.technique: r for r in catalog.eval_report_whole(t).collect()}["ALL"]
    assert (report.n, report.exact_match) == (4, 25.0)
    assert abs(report.ned - sum(d / max(len(u), len(a)) for d, (u, a) in zip(far, pairs, strict=True)) / 4) < 1e-6
    assert abs({r.technique: r.bleu for r in catalog.eval_bleu_whole(t).collect()}["ALL"] - bleu([(tokens(a), tokens(u)) for u, a in pairs])) < 1e-5
