import hashlib
import re

from procure_spark.llm import op01_secrets as op

KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    None, "", "nothing here", f'token = "{"a1" * 20}" end', f"{KEY} and {KEY}X", "password: short", "PASSWORD:longenough1 api-key=abcdefg api_key = 'zzzzzz'",
    "secret=token=abcdef", "passwordſ=abcdefgh K token:abcdef", "0123456789abcdef01234567 ABC 0123456789abcdef0123456", "x" * 300_000 + " token=abcdefg",
    f"user: bob\nendpoint https://db.example.com:5432/x\n{'Ab1' * 10} тест", f"user: bob{' ' * 400}{'Ab1' * 10}", "10.0.0.1 alone", f"host 10.0.0.1 {'Ab1' * 10}", f"host 10.0.0.1\n\n{'Ab1' * 10}", "a-" * 60_000,
]


def brute(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, rx, least, at in (("access", "AKIA[A-Z0-9]+", 20, 1), ("hex", "[0-9a-f]+", 24, 2)):
        found += [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, text) if len(m[0]) >= least]
    return [x for _, _, x in sorted(found)]


def test_base_spans_equal_brute_force_and_stay(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").repartition(3)
    rows = {r["doc_id"]: r for r in op.scan(df).collect()}
    for i, text in enumerate(TEXTS):
        base, r = brute(text), rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:50]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",")) | {""}


def spans(text):
    return op.written_out(op.linked(text, op.base_parts(text)))


def test_weak_parts_need_a_complement_in_reach_and_scope():
    assert spans(TEXTS[11]).startswith("id:0:9,endpoint:19:") and ",token:" in spans(TEXTS[11])
    assert spans(TEXTS[12]) == "" and spans(TEXTS[13]) == "" and spans(TEXTS[15]) == ""
    assert [s.split(":")[0] for s in spans(TEXTS[14]).split(",")] == ["endpoint", "token"]


#: Pieces of a text, with the parts that each holds: kind, start and end in the piece.
PIECES = [
    ("user: bob", [("id", 0, 9)]), ("10.0.0.1", [("endpoint", 0, 8)]), ("Ab1" * 8, [("token", 0, 24)]), ("token=abcdefgh", [("assign", 0, 14)]), (KEY, [("access", 0, 20)]),
    ("https://example.com/articles/2024abcdefghij0123456789", [("endpoint", 0, 53)]), ("account: abcdef1234567890abcdefgh9", [("id", 0, 34)]),
    (f"{'a1.' * 12}example.org:8080", [("endpoint", 0, 52)]), ("no.host.x1:8080", []), ("\n\n", None), ("слово " * 40, []), ("line\n", []),
]


def test_links_equal_all_pairs():
    import random

    rng = random.Random(3)
    for _ in range(100):
        text, parts, scope = "", [], 0
        for piece, held in (rng.choice(PIECES) for _ in range(rng.randrange(1, 30))):
            scope += held is None
            parts += [(scope, len(text) + a, len(text) + b, kind) for kind, a, b in held or []]
            text += piece + " "
        strong = ("assign", "access", "hex")
        side = lambda kind: kind in ("assign", "hex", "token")
        wanted = [
            (a, b, kind) for at, a, b, kind in parts
            if kind in strong or any(other == at and side(k) != side(kind) and (y <= a and a - y <= op.REACH or x >= b and x - b <= op.REACH) for other, x, y, k in parts)
        ]
        assert op.linked(text, op.base_parts(text)) == wanted, text


def test_no_part_is_linked_with_a_piece_of_itself():
    for text in ("see https://example.com/articles/2024abcdefghij0123456789 for more", "account: abcdef1234567890abcdefgh9", "https://a.org/2024abcdefghij0123456789 https://b.org/2025abcdefghij0123456789", "user: x1 https://b.org/2025abcdefghij0123456789"):
        assert spans(text) == ""
    assert spans("a." * 40_000 + "b:80") == "" and spans(f"{'x-' * 40_000}.com:80 " + "Ab1" * 8) == ""


def test_redaction_keeps_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh!", "s"), (1, "token = abcdefgh!", "s"), (2, None, "t")], "doc_id int, text string, spans string")
    got = sorted(map(tuple, op.redact(df).collect()), key=str)
    assert got == [(1, "[assign]!", "s")] * 2 + [(2, None, "t")]
    assert op.scan(df.limit(0)).count() == 0 and op.scan(df).columns.count("spans") == 1


def test_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op.op1_multipart_secrets(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    assert {r["doc_id"]: r["spans"] for r in got.collect()} == {i: spans(t or "") for i, t in enumerate(TEXTS)}
