"""Conversation repair: the agenda against enumeration, spans against one agenda, odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from nearspark.llm import repair as R


def enumerated(rows):
    """Lightest (cost, audit) by trying every edit string with up to two inserts at a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            roles, audit, cost = "", "I" * ins[0], 3 * sum(ins)

            def ask():
                return "a" if roles[-1:] == "u" else "u"

            for _ in range(ins[0]):
                roles += ask()
            for (initial, fault), e, more in zip(rows, edits, ins[1:]):
                if e != "D":
                    if fault in (R.BLANK, R.DUPLICATE):
                        break
                    roles += initial if e == "K" else ask()
                    cost += (3 if e == "R" else 0) + (3 if fault == R.TRUNCATED else 0)
                else:
                    cost += 4
                audit += e + "I" * more
                for _ in range(more):
                    roles += ask()
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def some_rows(rng, n):
    return [(rng.choice("suuaa x"), rng.choice([0, 0, 0, R.BLANK, R.DUPLICATE, R.TRUNCATED])) for _ in range(n)]


def test_agenda_finds_the_lightest_repair():
    rng = random.Random(5)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4]:
        rows = some_rows(rng, n)
        assert min(R.lightest(rows).values()) == enumerated(rows), rows


@pytest.mark.parametrize("span", [1, 3, 7])
def test_spans_give_what_one_agenda_gives(span):
    rng = random.Random(span)
    for n in (1, 2, 6, 7, 21, 60):
        rows = some_rows(rng, n)
        whole, cut = R.Derivation(1000), R.Derivation(span)
        for r in rows:
            whole.add(*r)
            cut.add(*r)
        assert whole.result() == cut.result()


def report(spark, rows, schema="conv_id long, turn long, role string, text string"):
    got = R.repair_report(spark.createDataFrame(rows, schema))
    return {r.conv_id: r.asDict() for r in got.collect()}


def ids_with(k, n=1, turn="0"):
    """Ids whose row 0 gets damage ``k``."""
    import zlib
    return [i for i in range(5000) if zlib.crc32(f"{i}:{turn}".encode()) % 20 == k][:n]


def test_damage_and_edits(spark):
    drop, empty, strip, again, keep = (ids_with(k)[0] for k in (0, 1, 2, 3, 7))
    got = report(spark, [(i, 0, "user", "Hi.") for i in (drop, empty, strip, again, keep)])
    none = hashlib.sha256(b"").hexdigest()
    assert (got[drop]["audit"], got[drop]["cost"], got[drop]["repaired_sha256"]) == ("", 0, none)
    assert (got[empty]["blank"], got[empty]["audit"], got[empty]["cost"]) == (1, "D", 4)
    assert (got[strip]["truncated"], got[strip]["audit"], got[strip]["cost"]) == (1, "D", 4)
    assert (got[again]["duplicate"], got[again]["audit"], got[again]["cost"]) == (1, "DD", 8) or \
        (got[again]["audit"], got[again]["cost"]) == ("KDI", 7)
    assert (got[keep]["audit"], got[keep]["cost"]) == ("KI", 3)
    assert got[keep]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:").hexdigest()


def test_odd_rows(spark):
    rows = [(None, 1, "user", "A?"), (None, 2, "assistant", "B."), (1, None, None, None), (1, None, None, None),
            (2, 5, "user", "x " * 200_000 + "."), (2, 9, "assistant", "ok."), (3, 1, "", "."), (3, 1, "", ".")]
    got = report(spark, [(*r, "extra", 1, 2) for r in rows],
                 "conv_id long, turn long, role string, text string, audit string, place int, first int")
    assert set(got) == {None, 1, 2, 3}
    assert all(isinstance(v, int) for r in got.values() for c, v in r.items() if c in R._LONGS)
    assert got[1]["gaps"] == 0
    assert report(spark, []) == {}


def test_long_conversation_matches_plain_python(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["yes.", "no", f"line {t}!", ""]))
            for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = R.audits(df).collect()[0]
    seen, plain = set(), []
    for _, _, role, text in rows:
        fault = (R.BLANK if not text.strip() else R.DUPLICATE if (role, text) in seen
                 else R.TRUNCATED if text[-1] not in ".!?" else R.SOUND)
        seen.add((role, text))
        plain.append((role[0], fault))
    assert (found.cost, found.audit) == min(R.lightest(plain).values())
    lines = R.repaired(df, R.audits(df)).orderBy("place").collect()
    initials = "".join(r.role[0] for r in lines)
    assert re.fullmatch("(s?(ua)+)?", initials)
    assert [r.place for r in lines] == list(range(len(lines)))
    assert R.digests(R.repaired(df, R.audits(df))).collect()[0].repaired_sha256 == hashlib.sha256(
        "\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest()


def test_faults_count_first(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "a"), (1, 2, "user", " \t"), (1, 3, "user", " \t")],
                               "conv_id long, turn long, role string, text string")
    r = R.audits(df).select(F.struct("blank", "duplicate", "truncated").alias("x")).collect()[0].x
    assert tuple(r) == (2, 1, 1)
