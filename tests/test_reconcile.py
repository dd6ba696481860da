"""Reconciliation against a direct fold in ledger order, the golden cases, and the parts it is made of."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names, scoring
from ledgerloom.functions.money import PER_USD, formatted
from ledgerloom.functions.text import plain_number
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import updates as up

TX = "seq long, transaction_id string, reference_id string, payer string, payee string, amount double, currency string"
BANK = "seq long, bank_statement_id string, reference_number string, counterparty string, amount double, currency string"
ERP = "seq long, erp_id string, invoice_number string, customer_vendor_name string, expected_amount double, currency string"

#: The demo's transfers, bank rows and invoices.
DEMO_TX = [
    ("TX-1001", "REF-8801", "Acme Corporation", "Global Logistics Ltd", 15400.0, "USD"), ("TX-1002", "REF-8802", "Apex Retailers", "TechSupply Pvt Ltd", 450000.0, "INR"),
    ("TX-1003", "REF-8803", "Nairobi Enterprises", "Safari Ventures", 125000.0, "KES"), ("TX-1004", "REF-8804", "Euro Import Co", "Berlin Distro GmbH", 28900.0, "EUR"),
    ("TX-1005", "REF-8805", "Acme Corporation", "Global Logistics Ltd", 15400.0, "USD"), ("TX-1006", "REF-8806", "Oceanic Shipping", "Port Terminal Services", 72300.0, "USD"),
    ("TX-1007", "REF-8807", "Delta Innovations", "Omega Softwares", 18500.0, "USD"), ("TX-1008", "REF-8808", "Sun Energy Ltd", "Grid Power Corp", 940000.0, "INR"),
    ("TX-1009", "REF-8809", "Unrecognized Sender LLC", "Mystery Account Inc", 65000.0, "USD"), ("TX-1010", "REF-8810", "FastPay Merchant", "Supermarket Retail", 8400.0, "USD"),
]
DEMO_BANK = [
    ("BS-9001", "REF-8801", "Acme Corp", 15400.0, "USD"), ("BS-9002", "REF-8802", "Apex Retailers Ltd", 450000.0, "INR"), ("BS-9003", "REF-8803", "Nairobi Ent", 125000.0, "KES"), ("BS-9004", "REF-8804", "Euro Import Co", 28500.0, "EUR"),
    ("BS-9006", "REF-8806", "Oceanic Shipping", 72300.0, "USD"), ("BS-9007", "REF-8807", "Delta Innovations", 18500.0, "USD"), ("BS-9008", "REF-8808", "Sun Energy Limited", 940000.0, "INR"), ("BS-9010", "REF-8810", "FastPay Merchant", 8400.0, "USD"),
]
DEMO_ERP = [("ERP-5001", "REF-8801", "Global Logistics Ltd", 15400.0, "USD"), ("ERP-5002", "REF-8802", "TechSupply Pvt Ltd", 450000.0, "INR"), ("ERP-5003", "REF-8803", "Safari Ventures", 125000.0, "KES"), ("ERP-5004", "REF-8804", "Berlin Distro GmbH", 28900.0, "EUR")]


def numbered(rows):
    return [(i + 1, *r) for i, r in enumerate(rows)]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def alike(a, b):
    a, b = (" ".join(sorted((x or "").lower().split())) for x in (a, b))
    return 100.0 if a == b else (1 - (len(a) + len(b) - 2 * common(a, b)) / (len(a) + len(b))) * 100


def usd(amount, currency):
    code = (currency or "").upper()
    return amount / PER_USD[code] if code in PER_USD else amount


def half_up(x):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def direct(tx, bank, erp):
    """Every transfer against every ledger row, in order."""
    taken, out = set(), {}
    for seq, _, ref, payer, payee, amount, currency in sorted(tx):
        best, pick, mine = 0.0, (None, "BANK", 0.0), usd(amount, currency)
        for side, rows in (("BANK", bank), ("ERP", erp)):
            if side == "ERP" and best >= 85:
                break
            for _, ident, number, name, other, code in sorted(rows):
                if (side, ident) in taken:
                    continue
                gap = abs(mine - usd(other, code))
                score = max(alike(payer, name), alike(payee, name)) if side == "BANK" else alike(payee, name)
                bonus = 40.0 if ref and number and ref.strip() == number.strip() else 0.0
                raw = score * 0.4 + max(0.0, 100 - gap / (mine + 1e-5) * 100) * 0.4 + bonus
                if raw > best:
                    best, pick = min(100.0, half_up(raw)), (ident, side, half_up(gap))
        if best >= 90:
            taken.add((pick[1], pick[0]))
        out[seq] = (*pick, best)
    return out


def tables(spark, tx, bank, erp):
    return spark.createDataFrame(tx, TX), spark.createDataFrame(bank, BANK), spark.createDataFrame(erp, ERP)


def test_demo(spark):
    r = rc.reconcile(*tables(spark, numbered(DEMO_TX), numbered(DEMO_BANK), numbered(DEMO_ERP)))
    rows = {x.transaction_id: x for x in r.collect()}
    for n in (1, 2, 3, 6, 7, 8, 10):
        x = rows[f"TX-{1000 + n}"]
        assert (x.ledger_id, x.ledger_type, x.status, x.amount_difference, x.match_confidence) == (f"BS-{9000 + n}", "BANK", "matched", 0.0, 100.0)
    want = {"TX-1004": ("BS-9004", "BANK", "matched", 434.78, 100.0), "TX-1005": ("ERP-5001", "ERP", "partial", 0.0, 80.0), "TX-1009": ("ERP-5004", "ERP", "unmatched", 33586.96, 32.3)}
    for k, v in want.items():
        assert (rows[k].ledger_id, rows[k].ledger_type, rows[k].status, rows[k].amount_difference, rows[k].match_confidence) == v
    assert rows["TX-1005"].remarks == "Partial Match against ERP ledger record 'ERP-5001'. Slight amount difference of 0.0 USD or name variance."
    assert rows["TX-1001"].remarks == "Automated AI High-Confidence Match against BANK ledger record 'BS-9001'."
    found = {(x.transaction_id, x.anomaly_type): x.explanation for x in rc.anomalies(r).collect()}
    assert set(found) == {("TX-1005", "duplicate_charge"), ("TX-1005", "amount_mismatch"), ("TX-1009", "missing_settlement")}
    assert found["TX-1005", "duplicate_charge"] == "Potential duplicate charge detected. Identical amount USD 15400.0 and payer 'Acme Corporation' matches previous transaction 'TX-1001'."
    d = rc.dashboard(r).first()
    assert (d.total_transactions, d.matched, d.partial, d.unmatched, d.mismatched, d.open_anomalies, d.match_rate) == (10, 8, 1, 1, 2, 3, 80.0)
    assert rc.run_summary(r).first().message == "AI Reconciliation complete. 8/10 matched successfully."
    tx = spark.createDataFrame(numbered(DEMO_TX), TX)
    hand = spark.createDataFrame([("TX-1005", "B", "BANK", 1), ("TX-1005", "C", "ERP", 2)], "transaction_id string, ledger_id string, ledger_type string, seq int")
    after = up.manual_match(r.select(*rc.RESULT), hand)
    left = up.resolve_anomalies(rc.anomalies(r), hand)
    s = rc.dashboard_of(after, left, tx).first()
    assert (s.total_transactions, s.matched, s.open_anomalies) == (10, 9, 1) and after.where("transaction_id = 'TX-1005'").first().ledger_id == "C"
    assert rc.dashboard_of(after.limit(0), left, tx).first().total_transactions == 10


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_direct_fold(spark, seed):
    r = random.Random(seed)
    refs, who = ["R1", "R2", " R1 ", " ", "", None, "R3", "R4"], ["Ann Lee", "Lee Ann Ltd", "Bob", None, "Cid & Co", "an extraordinarily long company name that has well over sixty characters in it"]
    money = lambda: (r.choice([0.0, 10.0, 10.1, 12.0, 99.99, 100.0, 5000.0]), r.choice(["USD", "INR", "EUR", "XYZ", None]))
    tx = numbered([(f"T{i}", r.choice(refs), r.choice(who), r.choice(who), *money()) for i in range(40)])
    bank = numbered([(f"B{i}", r.choice(refs), r.choice(who), *money()) for i in range(30)])
    erp = numbered([(f"E{i}", r.choice(refs), r.choice(who), *money()) for i in range(20)])
    got = {x.seq: (x.ledger_id, x.ledger_type, x.amount_difference, x.match_confidence) for x in rc.reconcile(*tables(spark, tx, bank, erp)).collect()}
    assert got == direct(tx, bank, erp)


def test_one_reference_of_all(spark):
    """Hundreds of transfers compete for the rows of one reference; names of over 63 characters, too."""
    r = random.Random(9)
    who = ["Ann Lee", "Lee Ann", "Bob", "Cid & Co", "Cid and Company", "x" * 70 + " long", "Dora"]
    money = lambda: (r.choice([10.0, 10.1, 12.0, 99.99, 100.0, 101.0, 5000.0]), "USD")
    tx = numbered([(f"T{i}", "R", r.choice(who), r.choice(who), *money()) for i in range(150)])
    bank = numbered([(f"B{i}", "R", r.choice(who), *money()) for i in range(120)])
    erp = numbered([(f"E{i}", "R", r.choice(who), *money()) for i in range(90)])
    got = {x.seq: (x.ledger_id, x.ledger_type, x.amount_difference, x.match_confidence) for x in rc.reconcile(*tables(spark, tx, bank, erp)).collect()}
    assert got == direct(tx, bank, erp)


def test_similar_names_are_all_found(spark):
    r = random.Random(12)
    name = lambda: " ".join("".join(r.choice("aeiklmnost") for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(1, 4)))
    sort = lambda n: " ".join(sorted(n.split()))
    base = [name() for _ in range(150)] + ["", "日本 x"]
    words = {sort(x) for x in base} | {sort(x.replace("a", "e", 1)) for x in base} | {sort(x + " ltd") for x in base}
    probes = [("S", a, r.choice([99.0, 91.0, 84.0, 76.0, 61.0, 40.0, -5.0])) for a in {sort(x) for x in base}]
    got = {(x.a, x.name): x.s for x in names.similar(spark.createDataFrame(probes, "side string, a string, least double"), spark.createDataFrame([("S", w) for w in words], "side string, name string")).collect()}
    for _, a, least in probes:
        floor = max(b for b in names.BANDS if b <= least or b == names.BANDS[-1])
        assert {w: alike(a, w) for w in words if alike(a, w) >= floor} == {w: s for (x, w), s in got.items() if x == a}


def test_no_ledger_is_no_match(spark):
    x = rc.reconcile(*tables(spark, numbered(DEMO_TX[:1]), [], [])).first()
    assert (x.ledger_id, x.status, x.match_confidence, x.confidence_tier, x.ledger_type) == (None, "unmatched", 0.0, "low", "BANK")
    assert rc.reconcile(*tables(spark, [], numbered(DEMO_BANK), [])).count() == 0
    assert spark.range(1).select(scoring.stored(F.lit(None).cast("double")).alias("s")).first().s is None


def test_names_of_any_length(spark):
    r = random.Random(1)
    pairs = [("", ""), ("a", None), ("B a", "A b"), ("日本 x", "x 日本")]
    for n in (59, 60, 61, 64, 65, 119, 120, 121, 200):
        a = "".join(r.choice("abc d") for _ in range(n))
        pairs += [(a, a), (a, "".join(r.choice("abc d") for _ in range(n))), (a, a[3:] + "zz"), (a, "cab")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", names.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x.s for x in sorted(rows)] == [alike(*p) for p in pairs]


def test_text_and_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(plain_number(F.lit(x))) for x in (15400000.0, 434.78, 0.0001, 0.0, -1.5)] == ["15400000.0", "434.78", "0.0001", "0.0", "-1.5"]
    assert [one(formatted(F.lit(1234.5), F.lit(c))) for c in ("usd", "KES", "Xyz")] == ["$1,234.50", "KSh1,234.50", "Xyz 1,234.50"]
    assert [one(up.status_kind(F.lit(s))) for s in ("matched", "amount_mismatch", "pending_settlement", "missing_in_erp", "Matched")] == ["matched", "partial", "partial", "unmatched", "unmatched"]
    assert [one(up.status_label(F.lit(s))) for s in ("amount_mismatch", "pending_settlement", "missing_in_erp", "on_hold")] == ["Partial / Fee discrepancy", "Pending settlement", "Unmatched", "on hold"]
