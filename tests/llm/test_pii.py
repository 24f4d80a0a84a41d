import datetime
import hashlib
import random
import re

from quire.llm import pii as P
from quire.llm import queries as Q

R = random.Random(8)


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def card():
    body = "4" + "".join(R.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def moved(spark, values, key="k"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    return [r["text"] for r in P.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_stay_valid_and_distinct(spark):
    cards = sorted({card() for _ in range(200)})
    got = moved(spark, cards)
    assert all(luhn(g) and len(g) == 16 and g[0] == "4" for g in got) and len(set(got)) == len(cards) and got != cards
    ips = sorted({".".join(str(R.randint(0, 255)) for _ in range(4)) for _ in range(200)})
    out = moved(spark, ips)
    assert len(set(out)) == len(ips) and all(len(o.split(".")) == 4 and all(0 <= int(x) <= 255 for x in o.split(".")) for o in out)
    days = sorted({(datetime.date(1900, 1, 1) + datetime.timedelta(R.randint(0, 73048))).isoformat() for _ in range(200)})
    out = moved(spark, days)
    assert len(set(out)) == len(days) and all(1900 <= datetime.date.fromisoformat(o).year < 2100 for o in out)
    phones = [f"+1 ({R.randint(100, 999)}) 555-{R.randint(0, 9999):04d}" for _ in range(100)]
    out = moved(spark, phones)
    assert len(set(out)) == len(set(phones)) and all(len(o) == len(p) and o.startswith("+1 (") for o, p in zip(out, phones, strict=True))
    assert moved(spark, ["123-45-6789", "665-01-0001"])[0].count("-") == 2
    iban = moved(spark, ["DE89 3704 0044 0532 0130 00"])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban.startswith("DE")


def test_a_small_domain_is_permuted(spark):
    df = spark.range(1000).selectExpr("id", "lpad(cast(id as string), 3, '0') as d")
    got = df.select(P.permute_digits("k", "x", df["d"]).alias("m")).collect()
    assert sorted(r["m"] for r in got) == [f"{i:03d}" for i in range(1000)]


def test_links_keys_and_untouched(spark):
    c = card()
    a, b = moved(spark, [f"x {c}, y", f"{c[:4]} {c[4:8]}-{c[8:12]}-{c[12:]} z."])
    assert a[2:18] == "".join(ch for ch in b if ch.isdigit()) != c
    assert moved(spark, [c], "other") != moved(spark, [c])
    plain = ["no numbers", "4785380592391138", "2024-13-40", "000-12-1234", "999.1.1.1", "v1.2.3", "", None]
    assert moved(spark, plain) == plain
    assert moved(spark, ["hein.19@mail5.example.com"])[0].endswith("@mail5.example.com")


def test_no_python_and_columns(spark):
    df = spark.createDataFrame([(1, "ip 10.0.0.1 and 10.0.0.1", 3, "x", "z"), (None, None, 1, "y", "z")], "doc_id long, text string, found int, __tokens string, TOKENS string")
    out = P.pseudonymise(df, "k", found="n", changed="m")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert out.columns == [*df.columns, "n", "m"]
    first, second = out.orderBy("n").collect()[::-1]
    assert (first["n"], first["m"], second["text"], second["n"]) == (2, 2, None, 0)
    words = first["text"].split()
    assert words[1] == words[3] != "10.0.0.1"
    assert P.pseudonymise(df.where("false"), "k").count() == 0


def test_every_date_moves_to_its_own(spark):
    start = datetime.date(1900, 1, 1)
    days = [start + datetime.timedelta(k) for k in range(319 * 229 - 2)]
    days = [d for d in days if d.year < 2100]
    for forms in (["%Y-%m-%d"], ["%d.%m.%Y"], ["%d/%m/%Y", "%m/%d/%Y"]):
        values = sorted({d.strftime(f) for d in days for f in forms})
        got = moved(spark, values)
        assert len(set(got)) == len(values)
        if len(forms) == 2:
            assert set(got) == set(values)
            kind = lambda v: (int(v[:2]) > 12, int(v[3:5]) > 12)
            assert all(kind(a) == kind(b) for a, b in zip(values, got, strict=True))
            assert sum(a == b for a, b in zip(values, got, strict=True)) < 0.01 * len(values) + 60
    assert moved(spark, ["31/02/2001", "30/30/2001", "29/02/2001", "00/12/2001"]) == ["31/02/2001", "30/30/2001", "29/02/2001", "00/12/2001"]


def test_very_long_texts_and_domains(spark):
    texts = ["x@" + "a." * 100_000 + "com", "y@" + "ab." * 100_000 + "com", "a." * 500_000, "1-" * 300_000, "x@a.b.example.com " * 20_000, "A" * 1_000_000, "DE12" + "ABCD " * 200_000, "1.2." * 200_000]
    got = moved(spark, texts)
    assert got[0] == texts[0] and got[2] == texts[2] and [len(g) for g in got] == [len(t) for t in texts]
    assert len(set(got[4].split())) == 1 and "x@a.b" not in got[4]


def _feistel(key, kind, left, m, right, n):
    digest = lambda i, size, v: int(hashlib.sha256(f"{key}|{kind}|{i}|{size}|{v}".encode()).hexdigest()[:15], 16) % size
    for i in range(P.ROUNDS):
        if i % 2:
            right = (right + digest(i, n, left)) % n
        else:
            left = (left + digest(i, m, right)) % m
    return left, right


def _digits_moved(key, kind, d):
    a = len(d) // 2
    left, right = _feistel(key, kind, int(d[:a] or 0), 10**a, int(d[a:]), 10 ** (len(d) - a))
    return (f"{left:0{a}d}" if a else "") + f"{right:0{len(d) - a}d}"


def _refilled(token, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in token)


def _brute_date(key, t):
    base = datetime.date(1900, 1, 1)
    for sign, form in (("-", "%Y-%m-%d"), (".", "%d.%m.%Y")):
        if sign in t:
            try:
                day = (datetime.datetime.strptime(t, form).date() - base).days
            except ValueError:
                return t
            left, right = _feistel(key, "date", day // 229, 319, day % 229, 229)
            return (base + datetime.timedelta(left * 229 + right)).strftime(form)
    a, b, y = int(t[:2]), int(t[3:5]), int(t[6:])
    if 1 <= a <= 12 and 1 <= b <= 12:
        left, right = _feistel(key, "slashed", (y - 1900) * 12 + a - 1, 2400, b - 1, 12)
        return f"{left % 12 + 1:02d}/{right + 1:02d}/{left // 12 + 1900}"
    day, month = max(a, b), min(a, b)
    try:
        datetime.date(y, month, day)
    except ValueError:
        return t
    sets = (
        [(y, m, d) for y in range(1900, 2100) for m in range(1, 13) for d in range(13, 29)],
        [(y, m, d) for y in range(1900, 2100) for m in (1, *range(3, 13)) for d in (29, 30)],
        [(y, m, 31) for y in range(1900, 2100) for m in (1, 3, 5, 7, 8, 10, 12)],
        [(y, 2, 29) for y in range(1904, 2100, 4)],
    )
    of = next(s for s in sets if (y, month, day) in s)
    width = {0: 16, 1: 2, 2: 7, 3: 7}[sets.index(of)]
    k = of.index((y, month, day))
    left, right = _feistel(key, "slashed", k // width, len(of) // width, k % width, width)
    y, month, day = of[left * width + right]
    return f"{day:02d}/{month:02d}/{y}" if a > 12 else f"{month:02d}/{day:02d}/{y}"


def _brute_email(key, t):
    local, rest = t.split("@")[0], t[t.index("@") :]
    h = len(local) // 2
    parts = [local[:h], local[h:]]
    for i in range(4):
        by, out = parts[1 - i % 2], ""
        for j, c in enumerate(parts[i % 2]):
            step = int(hashlib.sha256(f"{key}|email|{i},{j}|260|{by}".encode()).hexdigest()[:15], 16) % 260
            low, n = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (None, 1)
            out += c if low is None else chr((ord(c) - low + step) % n + low)
        parts[i % 2] = out
    return "".join(parts) + rest


def _brute_token(key, kind, t):
    d = re.sub("[^0-9]", "", t)
    if kind == "date":
        return _brute_date(key, t)
    if kind == "email":
        return _brute_email(key, t)
    if kind == "card":
        if not luhn(d) or not d.strip("0"):
            return t
        body = d[0] + _digits_moved(key, "card", d[1:-1])
        return _refilled(t, next(body + c for c in "0123456789" if luhn(body + c)))
    if kind == "ip":
        p = [int(x) for x in t.split(".")]
        left, right = _feistel(key, "ip", p[0] * 256 + p[1], 65536, p[2] * 256 + p[3], 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        areas = [x for x in range(1, 900) if x != 666]
        if area not in areas or not group or not serial:
            return t
        left, right = _feistel(key, "ssn", areas.index(area) * 99 + group - 1, 898 * 99, serial - 1, 9999)
        return f"{areas[left // 99]:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "phone":
        area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
        (ba, sa), (be, se) = ((0, 200) if x < 200 else (200, 800) for x in (area, exchange))
        left, right = _feistel(key, "phone", (area - ba) * se + exchange - be, sa * se, line, 10_000)
        return _refilled(t, f"{d[:-10]}{left // se + ba:03d}{left % se + be:03d}{right:04d}")
    value = t.replace(" ", "")
    remainder = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if remainder(value) != 1:
        return t
    inner = value[4:]
    body = _refilled(inner, _digits_moved(key, "iban", re.sub("[^0-9]", "", inner)))
    check = 98 - remainder(value[:2] + "00" + body)
    return _refilled(t, re.sub("[^0-9]", "", f"{check:02d}{body}"))


def brute(key, text):
    """The whole text moved token by token, and the numbers of tokens found and changed."""
    key, tokens = hashlib.sha256(key.encode()).hexdigest(), []

    def one(m):
        kind = next(k for k in P.KINDS if re.fullmatch(P.FORMS[k], m[0]))
        tokens.append((m[0], _brute_token(key, kind, m[0])))
        return tokens[-1][1]

    return re.sub(P.PATTERN, one, text), len(tokens), sum(a != b for a, b in tokens)


def test_brute_force(spark):
    values = [card() for _ in range(30)] + ["4785380592391138", "10.0.0.1", "255.255.255.255", "123-45-6789", "900-12-1234", "+1 (212) 555-0142", "212.555.0142", "hein.19@mail5.example.com", "A+b_9@x.org"]
    values += ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "GB30NWBK60161331926819", "2001-02-28", "2001-02-29", "31/12/1999", "12/31/1999", "01/02/2003", "29/02/2004", "30/04/2004", "28.02.2020", "30.02.2020"]
    texts = values + [f"{R.choice(values)}, {R.choice(values)} and {R.choice(values)}." for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["text"], r["n"], r["m"]) for r in P.pseudonymise(df, "k", found="n", changed="m").orderBy("doc_id").collect()]
    assert got == [brute("k", t) for t in texts]


def test_the_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = Q.op8_pii(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["text"], r["n_found"], r["n_replaced"]) == ((None, 0, 0) if t is None else brute(Q.PII_KEY, t))
