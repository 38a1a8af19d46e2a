"""Golden cases: arrivals per site and what must come out of them.

Each case owns one site. `expect` lists one outcome per arrival:
("accepted", n) with n readings stored, "replayed", or an error code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

T0 = "2026-08-09T12:00:00.000Z"


def r(kg="10.0000", ts=T0, device="TEST-DEVICE-01", rid=None, source="sensor"):
    return (rid, device, ts, kg, source)


@dataclass
class Case:
    name: str
    arrivals: list  # (key, [readings]) or (key, [(device, ts, grams)], "legacy")
    expect: list
    total: str
    count: int
    limit: str = "1000000.000"
    conflicts: list = field(default_factory=list)  # (reason, submitted, stored)
    events: list | None = None  # event types in order


OK = lambda n: ("accepted", n)
BAD = "VALIDATION_ERROR"
REUSED = "IDEMPOTENCY_KEY_REUSED"
REPLAY = "replayed"
K = [f"key-{i}" for i in range(60)]
U = [f"10000000-0000-4000-8000-{i:012d}" for i in range(20)]


def at(hhmm: str) -> str:
    return f"2026-08-09T{hhmm}:00.000Z"


CASES = [
    Case("G1 retry", [(K[0], [r("42.0000")])] * 2, [OK(1), REPLAY], "42.0000", 1,
         events=["measurements.ingested"]),
    Case("G2 reordered retry",
         [(K[0], [r("1", at("01:00")), r("2", at("02:00"))]),
          (K[0], [r("2", at("02:00")), r("1", at("01:00"))])], [OK(2), REPLAY], "3.0000", 2),
    Case("G3 respelled mass", [(K[0], [r("5.5000")]), (K[0], [r("5.5")])], [OK(1), REPLAY],
         "5.5000", 1),
    Case("G3b respelled instant",
         [(K[0], [r("5", "2026-08-09T01:00:00.000Z")]),
          (K[0], [r("5", "2026-08-08T20:00:00-05:00")])], [OK(1), REPLAY], "5.0000", 1),
    Case("G4 key reused", [(K[0], [r("10")]), (K[0], [r("999")])], [OK(1), REUSED], "10.0000", 1),
    Case("G5 no key", [(None, [r()]), ("   ", [r()])], [BAD, BAD], "0.0000", 0, events=[]),
    Case("G7 same reading, two keys", [(K[0], [r("30")]), (K[1], [r("30")])], [OK(1), OK(0)],
         "30.0000", 1, events=["measurements.ingested"] * 2),
    Case("G8 overlap",
         [(K[0], [r("1", at("03:00"))]), (K[1], [r("1", at("03:00")), r("2", at("04:00"))])],
         [OK(1), OK(1)], "3.0000", 2),
    Case("G9 value conflict", [(K[0], [r("10")]), (K[1], [r("47.5")])], [OK(1), OK(0)],
         "10.0000", 1, conflicts=[("value_conflict", "47.5000", "10.0000")]),
    Case("G10 key reused by id", [(K[0], [r(rid="A")]), (K[0], [r(rid="B")])], [OK(1), REUSED],
         "10.0000", 1),
    Case("G11 identity twice in a batch", [(K[0], [r("1"), r("2")])], [BAD], "0.0000", 0),
    Case("G12 two ids at one instant", [(K[0], [r("10", rid="x1"), r("20", rid="x2")])], [OK(2)],
         "30.0000", 2),
    Case("G13 identified after anonymous", [(K[0], [r("50")]), (K[1], [r("50", rid="a")])],
         [OK(1), OK(0)], "50.0000", 1, conflicts=[("mixed_identity", "50.0000", "50.0000")]),
    Case("G14 anonymous after identified", [(K[0], [r("50", rid="a")]), (K[1], [r("50")])],
         [OK(1), OK(0)], "50.0000", 1, conflicts=[("mixed_identity", "50.0000", "50.0000")]),
    Case("G15 both schemes in a batch", [(K[0], [r("1"), r("2", rid="a")])], [BAD], "0.0000", 0),
    Case("G16 mass too large", [(K[0], [r("99999999999.0")])], [BAD], "0.0000", 0),
    Case("G17 ids at one instant, two batches",
         [(K[0], [r("10", rid="r-1")]), (K[1], [r("47.5", rid="r-2")])], [OK(1), OK(1)],
         "57.5000", 2),
    Case("G18 same id, two keys", [(K[0], [r("12", rid="a")]), (K[1], [r("12", rid="a")])],
         [OK(1), OK(0)], "12.0000", 1),
    Case("G19 same id, clock corrected",
         [(K[0], [r("100", at("10:00"), rid="a")]),
          (K[1], [r("100", "2026-08-09T09:59:58.000Z", rid="a")])], [OK(1), OK(0)], "100.0000", 1),
    Case("G20 one id, two devices",
         [(K[0], [r("10", device="d1", rid="1")]), (K[1], [r("25", device="d2", rid="1")])],
         [OK(1), OK(1)], "35.0000", 2),
    Case("G21 same id, other mass elsewhere",
         [(K[0], [r("100", at("10:00"), rid="a")]), (K[1], [r("250", at("11:00"), rid="a")])],
         [OK(1), OK(0)], "100.0000", 1, conflicts=[("value_conflict", "250.0000", "100.0000")]),
    Case("G22 id at two instants in a batch",
         [(K[0], [r("1", at("10:00"), rid="a"), r("1", at("11:00"), rid="a")])], [BAD],
         "0.0000", 0),
    Case("G23 ten identical",
         [(K[0], [r("100", at("01:00")), r("100", at("02:00"))])] * 10, [OK(2)] + [REPLAY] * 9,
         "200.0000", 2),
    Case("G24 ten distinct", [(K[i], [r("10", at(f"0{i}:00"))]) for i in range(10)], [OK(1)] * 10,
         "100.0000", 10),
    Case("G25 same reading, two keys", [(K[0], [r("25")]), (K[1], [r("25")])], [OK(1), OK(0)],
         "25.0000", 1),
    Case("G27 mixed load",
         [(K[0], [r("2", at("00:00"))])] * 4
         + [(K[i], [r("3", at(f"0{i}:00"))]) for i in range(1, 7)]
         + [(K[10 + i], [r("1", at("0%d:00" % i))]) for i in range(1, 2)],
         [OK(1)] + [REPLAY] * 3 + [OK(1)] * 6 + [OK(0)], "20.0000", 7,
         conflicts=[("value_conflict", "1.0000", "3.0000")]),
    Case("G28 at the limit", [(K[0], [r("100.0000")])], [OK(1)], "100.0000", 1, limit="100.000",
         events=["measurements.ingested"]),
    Case("G28b just over", [(K[0], [r("100.0001")])], [OK(1)], "100.0001", 1, limit="100.000",
         events=["measurements.ingested", "site.limit_exceeded"]),
    Case("G30 full batch",
         [(K[0], [r("1", f"2026-08-09T10:{i // 60:02d}:{i % 60:02d}Z") for i in range(100)])],
         [OK(100)], "100.0000", 100),
    Case("G30b too many", [(K[0], [r("1", f"2026-08-09T10:{i // 60:02d}:{i % 60:02d}Z")
                                   for i in range(101)])], [BAD], "0.0000", 0),
    Case("G30c empty", [(K[0], [])], [BAD], "0.0000", 0),
    Case("G34 grams",
         [(U[0], [("d", 1754700000, "8200")], "legacy"), (U[1], [("d", 1754700060, "8.2")], "legacy")],
         [OK(1), OK(1)], "8.2082", 2),
    Case("G35 legacy retry", [(U[0], [("d", 1754700000, "5000")], "legacy")] * 2, [OK(1), REPLAY],
         "5.0000", 1),
    Case("G36 legacy then current",
         [(U[0], [("d", 1786276800, "5000")], "legacy"), (K[0], [r("5.0000", T0, "d")])],
         [OK(1), OK(0)], "5.0000", 1),
    Case("legacy repeats inside a batch, other mass: first wins, silent",
         [(U[0], [("d", 1754700000, "5000"), ("d", 1754700000, "7000")], "legacy")], [OK(1)],
         "5.0000", 1),
    Case("legacy repeats of a stored instant each conflict",
         [(U[0], [("d", 1754700000, "5000")], "legacy"),
          (U[1], [("d", 1754700000, "6000"), ("d", 1754700000, "7000")], "legacy")],
         [OK(1), OK(0)], "5.0000", 1,
         conflicts=[("value_conflict", "6.0000", "5.0000"), ("value_conflict", "7.0000", "5.0000")]),
    Case("G37 crossing once",
         [(K[i], [r("6", at(f"0{i}:00"))]) for i in range(3)], [OK(1)] * 3, "18.0000", 3,
         limit="10",
         events=["measurements.ingested", "measurements.ingested", "site.limit_exceeded",
                 "measurements.ingested"]),
    # A chain of verdicts: the id is refused at 01:00, so 02:00 is free for it,
    # which in turn refuses the anonymous reading there.
    Case("chain of schemes",
         [(K[0], [r("1", at("01:00"))]), (K[1], [r("1", at("01:00"), rid="a")]),
          (K[2], [r("2", at("02:00"), rid="a")]), (K[3], [r("2", at("02:00"))]),
          (K[4], [r("3", at("03:00"), rid="a")]), (K[5], [r("3", at("03:00"))])],
         [OK(1), OK(0), OK(1), OK(0), OK(0), OK(1)], "6.0000", 3,
         conflicts=[("mixed_identity", "1.0000", "1.0000"), ("mixed_identity", "2.0000", "2.0000"),
                    ("value_conflict", "3.0000", "2.0000")]),
    Case("trimmed ids", [(K[0], [r("1", device=" d\t", rid=" a ")]),
                         (" key-0 ", [r("1", device="d", rid="a")])], [OK(1), REPLAY], "1.0000", 1),
    Case("finer than a millisecond is one instant",
         [(K[0], [r("1", "2026-08-09T12:00:00.1231Z")]), (K[1], [r("1", "2026-08-09T12:00:00.1239Z")])],
         [OK(1), OK(0)], "1.0000", 1),
    Case("bad fields",
         [(K[0], [r("-1")]), (K[1], [r("1.00000")]), (K[2], [r("1", "2026-08-09T12:00:00")]),
          (K[3], [r("1", "2026-02-30T12:00:00Z")]), (K[4], [r("1", device="  ")]),
          (K[5], [r("1", device="x" * 101)]), (K[6], [r("1", source="drone")]),
          (K[7], [r("1", rid="")]), (K[8], [r("1\n")]), (K[9], [r(None)])],
         [BAD] * 10, "0.0000", 0),
    Case("source defaults to sensor", [(K[0], [r("1", source=None)]), (K[0], [r("1")])],
         [OK(1), REPLAY], "1.0000", 1),
]
