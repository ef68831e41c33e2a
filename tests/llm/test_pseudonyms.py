import datetime as dt
import hashlib
import random
import re

import pytest

from lorespark.llm import pseudonyms as P


def scrubbed(make, texts, key="lorespark"):
    out = P.scrub(make(list(enumerate(texts))), key).orderBy("doc_id").collect()
    return [r.text for r in out], out


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


FOUND = [
    ("email", "write to Bob.Smith92@mail3.example.com, please", r"^write to [a-z]{3}\.[a-z]{5}\d\d@mail3\.example\.com, please$"),
    ("phone", "call +1 (743) 555-3824 now", r"^call \+1 \(\d{3}\) \d{3}-\d{4} now$"),
    ("card", "card 4785380592391139###", r"^card 478538\d{10}###$"),
    ("card", "card 4111-1111-1111-1111.", r"^card 4111-11\d\d-\d{4}-\d{4}\.$"),
    ("ip", "at 152.143.123.131!", r"^at \d+\.\d+\.\d+\.\d+!$"),
    ("date", "born 1987-02-28", r"^born (19|20)\d\d-\d\d-\d\d$"),
    ("date", "born 28.02.1987", r"^born \d\d\.\d\d\.(19|20)\d\d$"),
    ("ssn", "ssn 123-45-6789", r"^ssn \d{3}-\d\d-\d{4}$"),
    ("iban", "to DE89 3704 0044 0532 0130 00", r"^to DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d$"),
]


def test_formats(make):
    texts = [t for _, t, _ in FOUND]
    got, rows = scrubbed(make, texts)
    for (kind, before, form), after, r in zip(FOUND, got, rows, strict=True):
        assert re.search(form, after, re.I) and after != before and r[f"n_{kind}"] == 1, (before, after)
    digits = re.sub(r"\D", "", got[2])
    assert luhn(digits) and luhn(re.sub(r"\D", "", got[3]))
    iban = got[8][3:].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_invalid_values_stay(make):
    texts = ["4785380592391138", "300.1.1.1", "1.2.3.4.5", "31/02/1990", "000-12-3456", "666-12-3456", "DE88 3704 0044 0532 0130 00", "12345678901234567890", "9@a", "0000000000000000", "version 1.02.3", "a..b@c.de"]
    got, rows = scrubbed(make, texts)
    assert got == texts


def test_linked_and_keyed(make):
    a = ["x +1 (743) 555-3824", "y +1 743 555 3824", "z +1 (743) 555-3825", "bob@a.org BOB@a.org"]
    got, _ = scrubbed(make, a)
    digits = [re.sub(r"\D", "", t) for t in got[:3]]
    assert digits[0] == digits[1] != digits[2]
    left, right = got[3].split()
    assert left.upper() == right.upper() and left != right
    assert scrubbed(make, a, "other")[0] != got and scrubbed(make, a)[0] == got
    with pytest.raises(ValueError):
        P.replacement("it's")


def test_it_is_a_permutation(spark):
    days = spark.range(2000).selectExpr("cast(date_add(date'1900-01-01', cast(id * 36 as int)) as string) as m")
    assert days.selectExpr(f"({P.replacement('k')}).new as n").distinct().count() == 2000
    small = spark.range(1000).selectExpr("concat('1.1.', id div 256, '.', id % 256) as m")
    assert small.selectExpr(f"({P.replacement('k')}).new as n").distinct().count() == 1000
    tens = spark.range(100).selectExpr("lpad(cast(id as string), 2, '0') as x")
    assert tens.selectExpr(f"{P._permute('k', 't', 'x')} as n").distinct().count() == 100
    abc = spark.range(1000).selectExpr("concat(chr(97 + id % 26), chr(48 + id % 10), chr(65 + id % 17)) as x").distinct()
    assert abc.selectExpr(f"{P._permute('k', 't', 'x')} as n").distinct().count() == abc.count()


def test_edges(make, clash):
    rows = [(1, None), (2, ""), (3, "no find"), (3, "no find"), (None, "bob@a.org"), (4, "é" * 5000 + " 10.0.0.7 " + "x" * 5000)]
    d = clash(make(rows))
    out = P.pseudonymise(d, kinds=None)
    assert out.columns == d.columns
    names = [f"c{i}" for i in range(len(d.columns))]
    got = {str(r.c0) + str(len(r.c1 or "")): r.c1 for r in out.toDF(*names).collect()}
    assert got["10"] is None and got["20"] == "" and got["37"] == "no find" and "10.0.0.7" not in got["4" + max((k[1:] for k in got if k.startswith("4")), key=len)]
    assert out.count() == 6 and P.scrub(d.limit(0)).count() == 0
    kinds = P.pseudonymise(make(rows))
    assert kinds.columns[-1] == "pii" and {r.doc_id: r.pii for r in kinds.collect()}[1] is None
    plan = kinds._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_cards_ibans_and_dates_beside_other_words(make):
    inside = [
        ("card", "card %s 123", "4111 1111 1111 1111"), ("card", "%s 12/26", "4111111111111111"), ("card", "12 %s", "4111 1111 1111 1111"), ("card", "id-%s", "4111111111111111"), ("card", "1234 5678 %s.", "4111 1111 1111 1111"),
        ("iban", "%s EUR 50", "BE68539007547034"), ("iban", "%s BIC X", "AT611904300234573201"), ("iban", "%s 2024", "ES9121000418450200051332"), ("date", "on %s", "02/28/1987"),
    ]
    got, rows = scrubbed(make, [form % value for _, form, value in inside])
    for (kind, form, value), after, r in zip(inside, got, rows, strict=True):
        left, right = form.split("%s")
        new = after[len(left) : len(after) - len(right)]
        assert after == left + new + right and len(new) == len(value) and new != value and r[f"n_{kind}"] == 1, (form, after)
        assert kind != "card" or luhn(re.sub(r"\D", "", new))
    assert int(got[8][3:5]) <= 12
    texts = ["4111111111111111 5500005555555559", "BE68539007547034 DE89 3704 0044 0532 0130 00", "ES9121000418450200051332 2024-05-01", "4111111111111111 28.02.1987", "BE68539007547034 BOB1@a.org", "4111111111111111 123-45-6789"]
    got, rows = scrubbed(make, texts)
    want = [{"card": 2}, {"iban": 2}, {"iban": 1, "date": 1}, {"card": 1, "date": 1}, {"iban": 1, "email": 1}, {"card": 1, "ssn": 1}]
    assert [{k: r[f"n_{k}"] for k in P.KINDS if r[f"n_{k}"]} for r in rows] == want


class Twin:
    """The pseudonyms in plain Python, written from the module's description; only the pattern is shared."""

    def __init__(self, key="lorespark"):
        self.key = key

    def number(self, kind, a, b, x):
        left, right = divmod(x, b)
        mix = lambda i, v: int(hashlib.sha256(f"{self.key}:{kind}:{i}:{v}".encode()).hexdigest()[:13], 16)
        for i in range(8):
            if i % 2:
                right = (right + mix(i, left)) % b
            else:
                left = (left + mix(i, right)) % a
        return left * b + right

    def permuted(self, kind, text):
        at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
        v = [int(text[i]) if text[i].isdigit() else ord(text[i].lower()) - 97 for i in at]
        m = [10 if text[i].isdigit() else 26 for i in at]
        half = len(v) // 2
        a, b = v[:half], v[half:]
        for i in range(8):
            own, other, radix = (b, a, m[half:]) if i % 2 else (a, b, m[:half])
            said = ",".join(map(str, other))
            h = "".join(hashlib.sha512(f"{self.key}:{kind}:{i}:{len(own)}:{q}:{said}".encode()).hexdigest() for q in range(len(own) // 16 + 1))
            own[:] = [(x + int(h[8 * j : 8 * j + 8], 16)) % r for j, (x, r) in enumerate(zip(own, radix, strict=True))]
        out = list(text)
        for i, x in zip(at, a + b, strict=True):
            out[i] = str(x) if text[i].isdigit() else chr((65 if text[i].isupper() else 97) + x)
        return "".join(out)

    @staticmethod
    def spaced(values, like, keep):
        it = iter(values)
        return "".join(c if c in keep else next(it) for c in like)

    def card(self, m):
        d = re.sub("[^0-9]", "", m)
        if not re.fullmatch(P.CARD, m) or not luhn(d) or len(set(d)) == 1:
            return None
        body = d[:6] + self.permuted("card", d[6:-1])
        return self.spaced(body + next(c for c in "0123456789" if luhn(body + c)), m, " -")

    def iban(self, m):
        p = m.replace(" ", "")
        mod = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if not re.fullmatch(P.IBAN, m) or not 15 <= len(p) <= 34 or mod(p[4:] + p[:4]) != 1:
            return None
        account = self.permuted("iban", p[4:])
        return self.spaced(f"{p[:2]}{98 - mod(account + p[:2] + '00'):02d}{account}", m, " ")

    def date(self, m):
        first = dt.date(1900, 1, 1)
        if m[4] == "-":
            forms = ["%Y-%m-%d"]
        elif m[2] != m[5]:
            return None
        else:
            forms = [f"%d{m[2]}%m{m[2]}%Y"] + (["%m/%d/%Y"] if m[2] == "/" else [])
        for f in forms:
            try:
                day = (dt.datetime.strptime(m, f).date() - first).days
            except ValueError:
                continue
            if not 0 <= day < 17 * 4297:
                return None
            new = first + dt.timedelta(days=self.number("date", 17, 4297, day))
            return f.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
        return None

    def ssn(self, m):
        a, g, s = int(m[:3]), int(m[4:6]), int(m[7:])
        if not 0 < a < 900 or a == 666 or not g or not s:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        area, rest = divmod(self.number("ssn", 898, 99 * 9999, areas.index(a) * 99 * 9999 + (g - 1) * 9999 + s - 1), 99 * 9999)
        return f"{areas[area]:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"

    def ip(self, m):
        o = m.split(".")
        if any(int(x) > 255 or x != "0" and x[0] == "0" for x in o):
            return None
        return ".".join(map(str, self.number("ip", 65536, 65536, int.from_bytes(bytes(map(int, o)))).to_bytes(4)))

    def phone(self, m):
        code = re.match(r"[+][0-9]{1,3}(?=[^0-9])|[+][0-9]|", m)[0]
        rest = m[len(code) :]
        d = re.sub("[^0-9]", "", rest)
        if not 7 <= len(d) <= 14:
            return None
        it = iter(self.permuted("phone", d))
        return code + "".join(next(it) if c.isdigit() else c for c in rest)

    def email(self, m):
        local, _, domain = m.partition("@")
        if not re.search("[0-9A-Za-z]", local) or local[0] == "." or local[-1] == "." or ".." in local:
            return None
        return f"{self.permuted('email', local)}@{domain}"

    def replaced(self, m):
        """(kinds, new text) of one candidate."""
        kind = (
            "email" if "@" in m else "iban" if "A" <= m[0] <= "Z" else "date" if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}", m) else "ssn" if re.fullmatch(r"\d{3}-\d\d-\d{4}", m)
            else "phone" if m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m) else "ip" if re.fullmatch(r"\d{1,3}([.]\d{1,3}){3}", m) else "card"
        )
        new = getattr(self, kind)(m)
        if new is not None:
            return [kind], new
        if kind not in ("card", "iban"):
            return [], m
        kinds, out, at = [], "", 0
        edges = [0] + [i + 1 for i, c in enumerate(m) if c in " -"]
        for b in edges:
            for e in sorted({len(m), *(i for i, c in enumerate(m) if c in " -")}, reverse=True) if b >= at else ():
                piece = m[b:e]
                if 13 <= len(piece) <= 46 and (new := (self.iban if "A" <= piece[0] <= "Z" else self.card)(piece)):
                    kinds.append("iban" if "A" <= piece[0] <= "Z" else "card")
                    out, at = out + m[at:b] + new, e
                    break
        return kinds, out + m[at:]

    def scrub(self, text):
        kinds = []

        def one(x):
            found, new = self.replaced(x[0])
            kinds.extend(found)
            return new

        return (None if text is None else re.sub(P.PATTERN, one, text, flags=re.ASCII)), kinds


def test_documents_as_by_brute_force(spark, sf, make):
    """Every document of the table, and texts of values, broken values and neighbours put together at random."""
    r = random.Random(9)
    d = lambda n: "".join(r.choices("0123456789", k=n))
    body = lambda: (lambda b: b + next(c for c in "0123456789" if luhn(b + c)))(d(15))
    parts = [
        lambda: "DE89 3704 0044 0532 0130 00", lambda: "GB82WEST12345698765432", lambda: body(), lambda: " ".join(re.findall("....", body())), lambda: "-".join(re.findall("....", body())), lambda: d(16), lambda: f"{r.randint(1890, 2110)}-{r.randint(0, 13):02d}-{r.randint(1, 31)}",
        lambda: f"{r.randint(1, 31):02d}{r.choice('./')}{r.randint(1, 31):02d}{r.choice('./')}{r.randint(1900, 2099)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"+{r.randint(1, 999)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}",
        lambda: ".".join(str(r.randint(0, 300)) for _ in range(4)), lambda: f"{r.choice(['a.b', 'Bob', '.x', 'z9_%'])}@mail.example.org", lambda: "EUR", lambda: d(3), lambda: "12/26", lambda: "word", lambda: "BIC X", lambda: "é",
    ]
    made = [r.choice(["", " ", "x "]) + r.choice([" ", " ", "-", ", "]).join(r.choice(parts)() for _ in range(r.randint(1, 5))) for _ in range(600)]
    texts = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + made
    got = P.scrub(make(list(enumerate(texts)))).collect()
    found = 0
    for x in got:
        want, kinds = Twin().scrub(texts[x.doc_id])
        assert x.text == want, (texts[x.doc_id][:200], x.text[:200], want[:200])
        assert [x[f"n_{k}"] for k in P.KINDS] == [kinds.count(k) for k in P.KINDS]
        found += len(kinds)
    assert len(got) == len(texts) and found > 500


def made_card(r, size):
    body = "4" + "".join(r.choices("0123456789", k=size - 2))
    return body + next(c for c in "0123456789" if luhn(body + c))


@pytest.mark.parametrize("n", [60, 6000])
def test_stretches_of_any_length(make, n):
    """Neither cards nor IBANs are lost in a stretch, however many it joins."""
    r = random.Random(4)
    cards = {size: [made_card(r, size) for _ in range(n)] for size in (13, 15, 16, 19)}
    texts = [sep.join(c) for c in cards.values() for sep in " -"]
    texts.append(" ".join(" ".join(re.findall("....", c)) for c in cards[16]))
    texts.append(" ".join(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"] * (n // 2)))
    got, rows = scrubbed(make, texts)
    for before, after, x in zip(texts[:-1], got, rows, strict=False):
        assert x.n_card == n and len(after) == len(before) and after != before
    assert rows[-1].n_iban == n and len(got[-1]) == len(texts[-1])


def test_runs_of_letters_and_digits_without_end(make):
    texts = ["AB12" + "C3D4" * 50_000, "1" * 200_000, "1 " * 20_000 + "4111 1111 1111 1111", "DE89 3704 0044x", "AB12 3456 7890 12345", "DE89 3704 0044 0532 0130 00x"]
    got, rows = scrubbed(make, texts)
    assert [r.n_card for r in rows[:2]] == [0, 0] and rows[2].n_card >= 1 and [t for t in got[3:]] == texts[3:] and got[:2] == texts[:2]


def test_no_large_sql_is_parsed(make, monkeypatch):
    """What the parser keeps in the driver grows with the largest expression, so there is none of all kinds together."""
    sizes = []
    monkeypatch.setattr(P.F, "expr", lambda s, expr=P.F.expr: sizes.append(len(s)) or expr(s))
    got, _ = scrubbed(make, [t for _, t, _ in FOUND])
    assert all(re.search(form, after, re.I) for (_, _, form), after in zip(FOUND, got, strict=True))
    assert sizes and max(sizes) < 10_000 < len(P.replacement("lorespark"))
