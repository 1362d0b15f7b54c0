"""Rewrites of assembly functions keep what they compute."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import asm, rewrites
from quern.plans import catalog

BODY = ["f:", "\t.cfi_startproc", "\tsub sp, sp, #32", "\tmov x3, #77", "        mov x4, x0", "\tadd x0, x0, #4", "\tadd x5, sp, #16", "\tlsl x6, x1, #1", "\tneg w7, w2", "\tmov w8, w3", "\tcmp w1, #3", "\tb.ge .L1", "\tsub x0, x0, #1000",
        "\tcmp x2, x1", "\tb.eq .L2", ".L1:", "\tmul x0, x0, x3", "\teor x1, x1, x0", ".L2:", "\tsub x2, x2, #1", "\tcbnz x2, .L1", "\tadd sp, sp, #32", "\tret", "\t.cfi_endproc"]
KEPT = [*(f"x{n}" for n in range(9)), *(f"x{n}" for n in range(16, 31)), "sp"]


def results(text, rng):
    start = {f"x{n}": rng.randrange(1 << 64) for n in range(31)} | {"sp": 1 << 20, "x2": rng.randrange(1, 9)}
    end = rewrites.executed(text, start)
    return [end[r] for r in KEPT]


@pytest.mark.parametrize("kind", rewrites.TRANSFORMS)
def test_each_rewrite_keeps_the_registers(kind):
    for seed in range(60):
        rows = rewrites.transformed(BODY, kind, 1.0, random.Random(seed))
        assert rows != BODY
        for k in range(3):
            assert results("\n".join(rows), random.Random(k)) == results("\n".join(BODY), random.Random(k))


def test_compositions_keep_the_registers():
    text, seen = "\n".join(BODY), set()
    for seed in range(150):
        out = rewrites.obfuscated(text, seed, most=4, intensity=(0.5, 1.0))
        seen.add(out)
        assert results(out, random.Random(seed)) == results(text, random.Random(seed))
    assert len(seen) > 100
    crowded = text.replace("\tret", "\n".join(f"\tadd x{n}, x{n}, #1" for n in range(9, 16)) + "\n\tret")  # no register is free
    for seed in range(40):
        assert results(rewrites.obfuscated(crowded, seed, most=4, intensity=(1.0, 1.0)), random.Random(1)) == results(crowded, random.Random(1))


def test_what_rewrites_leave():
    for kind in rewrites.TRANSFORMS:
        assert rewrites.transformed(BODY, kind, 0, random.Random(1)) == BODY
        full = rewrites.transformed(BODY, kind, 1, random.Random(1))
        assert full == rewrites.transformed(BODY, kind, 1, random.Random(1))
        kept = [r for r in BODY if rewrites.is_branch(r) or not rewrites.is_instruction(r)]
        assert [r for r in full if r in kept] == kept
    with pytest.raises(ValueError):
        rewrites.transformed(BODY, "dead_code", 2, random.Random(1))
    with pytest.raises(ValueError):
        rewrites.transformed(BODY, "other", 1, random.Random(1))
    text = "\n".join(BODY)
    assert rewrites.obfuscated(text, 3) == rewrites.obfuscated(text, 3) != rewrites.obfuscated(text, 3, epoch=1)
    assert rewrites.obfuscated("no body", 1) == "no body"


def test_usage(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nb"), ("a", "a")], "x string, y string")
    assert tuple(df.agg(*rewrites.usage(F.col("x"), F.col("y"))).first()) == (2, 1, 3, 4)


def test_added_immediate_is_added():
    for seed in range(30):
        out = rewrites.transformed(["\tadd x0, x0, #4", "\tsub x0, x0, #9"], "insn_sub", 1, random.Random(seed))
        assert rewrites.executed("\n".join(out), {"x0": 100})["x0"] == 95


UNIT = "\t.text\n\t.globl\tf\n\t.p2align 2\n\t.type\tf,@function\nf: // @f\n\t.cfi_startproc\n\tsub\tsp, sp, #16\n\tret\n\t.cfi_endproc\n\t.size f, .-f\n\t.globl g\ng:\n\tret\n"


def test_functions_of_units(spark):
    def got(f, unit, *names):
        return spark.createDataFrame([(unit,)], "u string").select(f(F.col("u"), *map(F.lit, names)).alias("y")).first()[0]

    assert got(asm.function_by_scope, UNIT, "g") == "\t.globl g\ng:\n\tret\n"
    assert got(asm.function_by_scope, UNIT, "f").endswith(".cfi_endproc") and got(asm.function_by_scope, UNIT, "h") is None
    assert got(asm.function_by_scope, ".global a\na:\n ret\n.Lfunc_end0:\nx", "a") == ".global a\na:\n ret"
    by_type = asm.function_by_type
    assert got(by_type, "\t.type\tf, %function\nf:\n\tret\n\t.size\tf, .-f\nx", "f") == "\t.global\tf\n\t.type\tf, %function\nf:\n\tret\n\t.size\tf, .-f"
    assert got(by_type, " .global f\n .align 1\n .type f, @function\n .align 2\nx\nf:\n ret", "f") == " .global f\n .type f, @function\n .align 2\nf:\n ret"
    assert got(by_type, "g:\n", "f") is None and got(by_type, "f:\n .type f, %function", "f") is None and got(by_type, None, "f") is None
    parts = lambda u, arch, mark: spark.createDataFrame([(u,)], "u string").select(asm.parts_of_unit(F.col("u"), F.lit("f"), arch, mark).alias("p")).first().p.asDict()
    assert parts("a\nf:\n ret // x\n .cfi_endproc\nb", "arm", "//") == {"pre": "a\n", "func": ".global f\n.type f, %function\nf:\n ret \n .cfi_endproc", "post": "b\n"}
    assert parts("a\n\t.globl f\nf:\n\tjr\tra\nb", "riscv", "#") == {"pre": "a\n", "func": ".globl f\n.type f, @function\nf:\n\tjr\tra", "post": "b\n"}
    assert parts("a\nb", "x86", "#") == {"pre": "a\nb\n", "func": ".globl f\n.type f, @function", "post": "\n"}
    literals = lambda u, f: spark.createDataFrame([(u, f)], "u string, f string").select(asm.with_literals(F.col("u"), F.col("f"))).first()[0]
    assert literals(".LC0:\n\t.string \"x\"\n.LC11:\r\n\n .word 1\na.3:\n 7", "adr .LC11\n .LC0 a.3 .LC9 .LC0") == "adr .LC11\n .LC0 a.3 .LC9 .LC0\n.LC11:  .word 1\n.LC0: \t.string \"x\"\na.3:  7\n"
    assert literals("x", "ret") == "ret\n\n"


def test_many_functions_are_rewritten_as_each_alone(spark):
    odd = "f:\n\t.cfi_startproc\n\tmov x0, #0x10\n\tadd x0,x0,#4 \n\n  .Lway_7: // x\n\tcmp x0, #07\n\tadd x1, x0, #5\n\tsub x1, x1, #123456789012345678901\n\tneg x2, x1\n\tb .Lway_3\n\tnop\n.Lway_3:\n\tret x30\n  .cfi_endproc\n\tnop\n"
    texts = ["\n".join(BODY), odd, "", "\n", "no body", *("\n".join([*BODY[:k], *BODY[2:]]) for k in range(3, 20))]
    code = rewrites.Code([t.split("\n") for t in texts])
    assert code.texts() == texts and code.lengths().tolist() == [len(t) for t in texts]
    rewrites.rewrite_all(code, range(len(texts)), 3, 2, 4, (0.5, 1.0))
    new = code.texts()
    assert new == [rewrites.obfuscated(t, i, 3, 2, 4, (0.5, 1.0)) for i, t in enumerate(texts)]
    assert code.lengths().tolist() == [len(t) for t in new] and new[2:5] == texts[2:5] and new[1].endswith("  .cfi_endproc\n\tnop\n")
    labels = [r.strip() for r in new[0].split("\n") if r.startswith(".Lway_")]
    assert len(labels) == len(set(labels))
    for seed in range(40):
        lines = rewrites.transformed(odd.split("\n"), "opaque_pred", 1, random.Random(seed))
        assert len(mine := [r.split(":")[0].strip() for r in lines if ".Lway_" in r and ":" in r]) == len(set(mine)) > 5


def test_functions_of_columns_run_as_their_texts():
    texts = ["\n".join([*BODY[:k], "\tadd x2, xzr, #1", *BODY[k:]]) for k in range(3, 11)]
    code = rewrites.Code([t.split("\n") for t in texts])
    rewrites.rewrite_all(code, range(8), most=4, intensity=(0.5, 1.0))
    start = {"x0": (1 << 64) - 5, "x1": 3, "x2": 4}
    got = list(rewrites.runs(code, start))
    assert got == [rewrites.executed(t, start) for t in code.texts()]
    assert [[g[r] for r in KEPT] for g in got] == [[rewrites.executed(t, start)[r] for r in KEPT] for t in texts]
    assert rewrites.executed("\tmov w1, #-1\n\tror x2, x1, #0x4\n\tasr w3, w1, #31\n\tb .L1\n\tjunk\n.L1:\n\ttbz w3, #31, .L1\n\tadd x4,x3 ,\tx2\nret") | {"x30": 7} == dict.fromkeys([*(f"x{n}" for n in range(31)), "sp"], 0) | {"x1": 0xFFFFFFFF, "x2": 0xF00000000FFFFFFF, "x3": 0xFFFFFFFF, "x4": 0xF00000010FFFFFFE, "x30": 7}
    for bad in ("\tjunk x1", "\tadd x0, x0", "\tadd x0, x0, #5 // #7", "f: // x"):
        with pytest.raises(ValueError):
            rewrites.executed(bad)
    with pytest.raises(ValueError):
        rewrites.executed("a:\n\tadd x0, x0, #1\n\tb a", steps=1000)


def test_texts_that_are_null_or_empty_make_functions(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "a\u00e9b \u00a0c\x0bd"), (4, " " * 9)], "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.x0, r.x1, r.longer) for r in catalog.QUERIES["asm_transforms"](spark, str(tmp_path)).collect()}
    assert got == {1: (7, 7, True), 2: (7, 7, True), 3: (13, 7, True), 4: (7, 7, True)}
