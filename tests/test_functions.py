"""Column functions against the cases that define them."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays, asm, metrics, text
from quern.operators import routing


def one(spark, value, f):
    """f of one string cell."""
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


IR = "; c\nsource_filename = \"a\"\n%struct.Zed = type { i32 }\n%struct.Ze = type { i8 }\n@.str = global\ndefine i32 @f(%struct.Ze* %a, %struct.Zed* %b) #0 {\n  ret i32 0, !tbaa !5\n}\ndeclare void @g() #1\nattributes #0 = { x }\n!0 = !{}\n"


@pytest.mark.parametrize("f", [text.normalize_structs, text.strip_ir_noise, text.truncate_ir])
def test_null_and_empty_stay(spark, f):
    assert one(spark, None, f) is None
    assert one(spark, "", f) == ""


def test_structs_are_numbered_by_first_appearance(spark):
    got = one(spark, "%struct.b %struct.ab\n%struct.b %struct.struct0", text.normalize_structs)
    assert got == "%struct.struct0 %struct.struct1\n%struct.struct0 %struct.struct2\n"


def test_noise(spark):
    got = one(spark, IR, text.strip_ir_noise)
    assert got.splitlines()[0] == "%struct.Zed = type { i32 }"
    assert "declare" not in got and "@.str" not in got and got.endswith("}")
    assert one(spark, got, text.strip_ir_noise) == got


def test_truncation(spark):
    assert one(spark, "a\ndefine i32 @f() {\n ret\n}\nrubbish\n}\n", text.truncate_ir) == "a\ndefine i32 @f() {\n ret\n}"
    assert one(spark, "}\nno function", text.truncate_ir) == "}\nno function"
    assert one(spark, "define i32 @f() {\n open", text.truncate_ir) == "define i32 @f() {\n open"


@pytest.mark.parametrize(("c", "want"), [
    ("x\n/* BEGIN FUNCTION-DEF f LOC=1 */\nint f;\n/* END FUNCTION-DEF f LOC=2 */\ny", "/* BEGIN FUNCTION-DEF f LOC=1 */\nint f;\n/* END FUNCTION-DEF f LOC=2 */"),
    ("/* BEGIN FUNCTION-DEF f */\nint f;", None), ("int f;\n/* END FUNCTION-DEF f */", None), ("/* BEGIN FUNCTION-DEF ff */\n/* END FUNCTION-DEF ff */", None), (None, None), ("", None),
])
def test_marked_spans(spark, c, want):
    assert one(spark, c, lambda x: text.extract_marked(x, F.lit("f"))) == want


def test_comments_and_white_space(spark):
    assert one(spark, "f: // x\n  ret // y\n\n// z", lambda c: text.strip_comments(c, F.lit(True))) == "f:\n  ret"
    assert one(spark, "a  \r\n\n b\t\n", text.clean_whitespace) == "a\n b\n"
    assert one(spark, "\n \n", text.clean_whitespace) == ""
    got = one(spark, IR, text.normalize_ir)
    assert got == one(spark, got, text.normalize_ir) and "!tbaa" not in got and "#0" not in got


def test_units_of_c(spark):
    assert one(spark, "typedef int bool;\n#define true 1\nint x;", text.clean_deps) == "int x;"
    got = one(spark, "static inline int main(void) { return 1; }", lambda c: text.translation_unit(c, F.lit(None).cast("string")))
    assert got.count("main") == 1 and "static" not in got and got.startswith("#include <stdlib.h>\n")
    assert one(spark, "static int *f(int a)", text.name_from_head) == "f"


def test_function_split(spark):
    parts = one(spark, "f:\n.cfi_startproc\nret\n.cfi_endproc\nx", text.split_function)
    assert (parts.header, parts.body, parts.footer) == (["f:", ".cfi_startproc"], ["ret"], [".cfi_endproc", "x"])
    parts = one(spark, "a\nb", text.split_function)
    assert (parts.header, parts.body, parts.footer) == ([], ["a", "b"], [])


UNIT = "\t.text\n\t.globl\tf\n\t.p2align 2\n\t.type\tf,@function\nf: // @f\n\t.cfi_startproc\n\tsub\tsp, sp, #16\n\tret\n\t.cfi_endproc\n\t.size f, .-f\n\t.globl g\ng:\n\tret\n"


def test_preprocessing(spark):
    got = one(spark, UNIT, lambda c: asm.preprocessed(c, F.lit("f")))
    assert got == ".global f\n.type f, %function\nf:\n\t.cfi_startproc\n\tsub\tsp, sp, #16\n\tret\n\t.cfi_endproc\n"
    assert one(spark, UNIT, lambda c: asm.preprocessed(c, F.lit("h"))) is None


@pytest.mark.parametrize(("a", "b", "want"), [
    ({"a": 1}, {"a": 1}, True), ({"a": 1}, {"b": 1}, False), ({"a": 1}, {"a": 1, "b": 2}, False), ([1, 2], [1], False), (1.0, 1.0001, True), (1.0, 2.0, False),
    (1, 1.0, True), ("hello", 42, False), (True, 1, True), ([{"x": [1.0]}], [{"x": [1.0005]}], True), (100000, 100001, False), (None, None, True),
])
def test_tolerant_comparison(a, b, want):
    assert asm.alike(a, b) is want


def test_literals():
    assert asm.literals_to_json(["a", "b"], ["1", "'x'"]) == '{"a": 1, "b": "x"}'
    assert asm.literals_to_json(["a"], ["f("]) is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_token_distance(spark):
    rng = random.Random(2)
    words = ["a", "b", "ab", "é", "😀", *(f"w{i}" for i in range(30))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(40))), " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(60)] + [("", ""), ("a b", None), (" ".join(f"v{i}" for i in range(3000)), "v5")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(metrics.token_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [edits(a.split(), (b or "").split()) for a, b in rows]


def test_words_13a(spark):
    for given, want in (("Hello, world. It's 3.14-5!", "Hello , world . It's 3.14 - 5 !"), ("a&quot;b&amp;c (d) x-\ny\nz", 'a " b & c ( d ) xy z'), ("1,000 a,b .5", "1,000 a , b . 5"), ("ret i32 %x, align 4", "ret i32 % x , align 4"), ("", "")):
        assert one(spark, given, metrics.words_13a) == want.split()


def bleu(pairs):
    """Corpus BLEU of word lists, smoothed exponentially."""
    logs, half = 0.0, 1.0
    for n in range(1, 5):
        grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in p] for p in pairs]
        hit, all_ = sum((a & b).total() for a, b in grams), sum(a.total() for a, _ in grams)
        if (n == 1 and not hit) or not all_:
            return 0.0
        half = half / 2 if not hit else half
        logs += math.log((hit or half) / all_) / 4
    made, asked = (sum(len(p[i]) for p in pairs) for i in (0, 1))
    return 100 * min(1, math.exp(1 - asked / made)) * math.exp(logs)


@pytest.mark.parametrize("seed", range(6))
def test_bleu(spark, seed):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choices("abcdef"[: 2 + seed], k=rng.randrange(30)))
    rows = [(text(), text()) for _ in range(1 + seed)] if seed < 5 else [("a x b y c", "a q b r c s t")]
    got = spark.createDataFrame(rows, "p string, r string").agg(metrics.bleu_score(metrics.bleu_parts(F.col("p"), F.col("r")))).first()[0]
    assert math.isclose(got, bleu([(p.split(), r.split()) for p, r in rows]), abs_tol=1e-9)
    assert seed < 5 or 0 < got < 50


def test_lookups(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "", "3"]), (["a"], []), (None, None)], "k array<string>, v array<string>")
    rows = df.select(arrays.lookup(F.col("k"), F.col("v"), F.lit("a")).alias("a"), arrays.lookup(F.col("k"), F.col("v"), F.lit("b")).alias("b"), arrays.updated(F.col("k"), F.col("v"), F.lit("b"), F.lit("n")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [("1", None, ["1", "n", "3"]), (None, None, []), (None, None, None)]
    m = spark.createDataFrame([(["a", "b", "a"], ["1", "2", "3"])], "k array<string>, v array<string>").select(arrays.paired_map(F.col("k"), F.col("v")).alias("m")).first()[0]
    assert m == {"a": "3", "b": "2"}
    s = spark.createDataFrame([([4, 5, -100],), ([],)], "x array<int>").select(arrays.shifted(F.col("x")).alias("y")).collect()
    assert [r.y for r in s] == [[2, 4, 5], []]


def test_losses(spark):
    df = spark.createDataFrame([(-1.0, -2.0, -1.0, -2.0), (-1.0, -900000.0, -1.0, -2.0)], "a double, b double, c double, d double")
    own = [F.col(c) for c in "abcd"]
    got = [r[0] for r in df.select(metrics.preference_loss(*own, sft_weight=0.0)).collect()]
    assert math.isclose(got[0], math.log(2)) and 0 <= got[1] < 1e-9
    assert math.isclose(df.select(metrics.preference_loss(*own)).first()[0], math.log(2) + 0.1)
    with pytest.raises(ValueError):
        metrics.preference_loss(*own, kind="x")
    assert metrics.beams(7, 4) == 8 and metrics.beams(1, 5) == 5


def test_routes():
    assert routing.languages("opt3_ir_optz-ir_optz") == ("opt3", "ir_optz")
    assert routing.languages("clang_opt3_c-c") == ("clang_opt3", "c")
    assert routing.route("arm_ir-ir") == routing.Route("arm_ir-ir", "angha_gcc_arm_O0", "angha_clang_ir_O0", False)
    assert len(routing.PAIRS.split()) == 96 and len(set(routing.PAIRS.split()[2::3])) == 32
    assert routing.wrapping("arm_opt3") == ("<arm>", "</arm>", [("<opt3>", "</opt3>")])
    assert routing.wrapping("opt3", legacy=True)[2] == [("<opt3>", "</opt>")]
    for bad in ("x_y-y", "s_io-io"):
        with pytest.raises(ValueError):
            routing.route(bad)
    with pytest.raises(ValueError):
        routing.routed("arm_armopt-armopt")
    with pytest.raises(KeyError):
        routing.asm_key("armopt")
