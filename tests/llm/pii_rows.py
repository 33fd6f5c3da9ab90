"""300 rows, half of them without personal data, made apart from the table that the field is trained on."""

from __future__ import annotations

import random
import string
import uuid

AROUND = (
    "We looked at {} again this morning.", "{}", "Note: {} (see below)", "As I said, {} and nothing else.", "The text says {}", "Le lien {} ne marche plus.", "Bitte {} nicht vergessen.",
    "Then {} came up, which was fine.", "- {}\n- another item", "He wrote {}.", "{} is what the log shows", "On Monday {}, on Tuesday the rest",
)


def _pick(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def rows(seed: int = 77) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, spans as (kind, what it says))."""
    rng = random.Random(seed)
    hexa, alnum, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    word = lambda: rng.choice("report archive build session users static assets images blog post article release nightly theme vendor".split())
    blob = lambda n: _pick(rng, alnum, n - 1) + rng.choice(digits)

    def password() -> str:
        return rng.choice([
            rng.choice(["Sunny", "Tiger", "Maple", "Orbit", "Winter", "Coffee"]) + _pick(rng, digits, rng.randint(3, 4)) + rng.choice("xyzKQ"),
            _pick(rng, alnum, 8) + "7b", "tr0ub4dor" + _pick(rng, digits, 1) + "k", _pick(rng, alnum, 4) + "!9" + _pick(rng, string.ascii_letters, 5), _pick(rng, string.ascii_lowercase, 5) + "_" + _pick(rng, digits, 3) + "Zp",
        ])

    def positive() -> tuple[str, list[tuple[str, str]]]:
        kind = rng.choice(["secret"] * 6 + ["phone"] * 2 + ["card", "email", "ip"])
        if kind == "secret":
            long = rng.choice([blob(rng.choice([20, 24, 32, 36, 43])), _pick(rng, hexa, 39) + "5", "sk-" + blob(32), "ghp_" + blob(36), "AKIA" + _pick(rng, string.ascii_uppercase + digits, 15) + "7"])
            value = rng.choice([long, password()])
            cue = rng.choice(["password", "Password", "pwd", "passwd"]) if len(value) < 18 else rng.choice(["token", "api_key", "API_KEY", "secret", "access_token", "key"])
            return rng.choice([f"{cue}: {value}", f"{cue} = \"{value}\"", f"{cue}={value}", f"{cue}: \"{value}\"", f"the {cue} is {value}" if len(value) < 18 else f"{cue}: {value}"]), [(kind, value)]
        a, b, c = _pick(rng, "23456789", 3), _pick(rng, digits, 3), _pick(rng, digits, 4)
        if kind == "phone":
            value = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"])
            return rng.choice(["call", "phone", "tel:", "fax"]) + " " + value, [(kind, value)]
        if kind == "card":
            value = rng.choice(["4111.1111.1111.1111", "5500.0000.0000.0004", "4012.8888.8888.1881", "6011.1111.1111.1117"])
            return f"card {value}", [(kind, value)]
        if kind == "email":
            value = f"{rng.choice(['anna', 'li', 'omar', 'jean'])}@{word()}[.]{rng.choice(['org', 'com'])}"
            return f"mail {value}", [(kind, value)]
        value = "[.]".join(str(rng.randint(1, 255)) for _ in range(4))
        return f"host {value}", [(kind, value)]

    def negative() -> str:
        site = rng.choice(["https://example.org", "http://data.example.com", "https://www.museum-guide.net", "https://cdn.example.io:8443"])
        return rng.choice([
            f"{site}/a/{blob(24)}", f"{site}/{word()}/2021/07/{word()}-{word()}.html", f"{site}/watch?v={blob(11)}", f"{site}/{word()}?id={_pick(rng, digits, 9)}&lang=en", f"{site}/d/{blob(44)}/edit#gid=0", f"[{word()}]({site}/{blob(16)})",
            f"data {blob(44)}", f"the word {blob(44)} is data", blob(44), f"build-{_pick(rng, hexa, 16)}.tar.gz", f"{word()}-{_pick(rng, digits, 8)}.zip", f"{word()}.{_pick(rng, hexa, 8)}.min.js", f"IMG_{_pick(rng, digits, 8)}_{_pick(rng, digits, 6)}.jpg",
            f"ETag: \"{_pick(rng, hexa, 32)}\"", f"etag W/\"{_pick(rng, hexa, 20)}\"", f"/usr/lib/{word()}/{_pick(rng, hexa, 12)}/lib{word()}.so.6", f"/home/ann/{word()}/{word()}_{_pick(rng, digits, 4)}.csv", f"C:\\Users\\ann\\{word()}{_pick(rng, digits, 3)}.docx",
            f"commit {_pick(rng, hexa, 40)}", f"sha256:{_pick(rng, hexa, 64)}", f"md5 {_pick(rng, hexa, 32)}", f"integrity=\"sha384-{blob(64)}\"", str(uuid.UUID(int=rng.getrandbits(128))), f"#{_pick(rng, hexa, 6)}", f"0x{_pick(rng, hexa, 8)}", f"rev {_pick(rng, hexa, 7)}",
            f"version {rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", f"ISBN 978-3-16-{_pick(rng, digits, 6)}-0", f"order {_pick(rng, digits, 10)}", f"20{_pick(rng, digits, 2)}-1{rng.randint(0, 2)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00Z", f"{rng.randint(100, 999)} of {rng.randint(1000, 9999)} rows",
            f"the password has {rng.randint(8, 16)} characters", f"password rules from 20{_pick(rng, digits, 2)}", f"token {rng.randint(1, 9)} of {rng.randint(10, 99)}", f"key {rng.randint(1, 12)}", f"a token lives {rng.randint(10, 90)} minutes", f"{rng.randint(2, 40)} secrets of good bread", f"password reset: {site}/reset/{word()}",
            f"room B{rng.randint(10, 99)}, floor {rng.randint(1, 9)}", f"flight LH{_pick(rng, digits, 4)}", f"{rng.randint(10, 99)}.{rng.randint(1, 9)} %", f"docker pull {word()}/{word()}:{rng.randint(1, 9)}.{rng.randint(1, 9)}-slim", f"{word()}@{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"model XR-{_pick(rng, digits, 4)}b",
        ])

    out = []
    for i in range(300):
        body, spans = positive() if i % 2 else (negative(), [])
        out.append((rng.choice(AROUND).format(body), spans))
    return out
