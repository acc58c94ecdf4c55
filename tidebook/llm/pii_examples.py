"""A small labelled table for the field that finds personal data: sentences with marked spans.

Each sentence is a few plain words around one or two phrases. Phrases are written by rules below, with digits and
letters drawn from a seed; most are of forms that the exact patterns miss, and about half are numbers
and codes that are nothing personal.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from .pii import Span, luhn

#: Plain words of the sentences, and names used in addresses.
PLAIN = (
    "the a of and to in for on with from by this that which when please note our your new last first page see also report team office "
    "order price total value about after before under meeting results made many people found year time city work week value list number "
    "der die und mit von nicht ein el la de que en los un une les des pour dans est").split()
NAMES = "anna maria john peter li wei omar sara juan ines karl eva tom nina paul rosa ivan mia noah lena".split()
PLACES = "example mailbox acme northwind contoso university press library hospital studio market museum".split()
ENDS = "com org net edu io de fr es".split()
#: Words before a telephone number, an address, a secret.
CALL, WRITE = "call phone tel telephone fax mobile reach ring at on".split(), "mail email write contact to at address".split()
KEYS = "password passwd pwd secret token api_key apikey access_key auth_token client_secret api-key".split()

_HEX, _UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_MIXED = _UPPER + _LOWER + _DIGIT


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def of(self, letters: str, n: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(n))

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def card_digits(self) -> str:
        body = self.one("4", "51", "52", "37", "6011") + self.of(_DIGIT, 14)
        body = body[:15]
        return body + next(c for c in _DIGIT if luhn(body + c))

    def email(self) -> str:
        r = self.r
        name, place, end = r.choice(NAMES), r.choice(PLACES), r.choice(ENDS)
        full = f"{name}.{r.choice(NAMES)}"
        return self.one(
            f"{full}@{place}.{end}", f"{name}{self.of(_DIGIT, 2)}@{place}.{end}", f"{name} at {place} dot {end}", f"{name} dot {r.choice(NAMES)} at {place} dot {end}",
            f"{name} [at] {place} [dot] {end}", f"{full} (at) {place} (dot) {end}", f"{full}(at){place}.{end}", f"{full}[at]{place}[dot]{end}",
            f"{name} AT {place} DOT {end}", f"{full} @ {place}.{end}")

    def ip(self) -> str:
        part = lambda: str(self.r.randrange(256))
        group = lambda: self.of(_HEX, self.r.randrange(1, 5))
        return self.one(".".join(part() for _ in range(4)), ":".join(group() for _ in range(8)), f"2001:db8:{group()}::{group()}", f"fe80::{group()}:{group()}:{group()}:{group()}",
                        "-".join(part() for _ in range(4)).replace("-", "[.]"))

    def card(self) -> str:
        d = self.card_digits()
        parts = [d[k : k + 4] for k in range(0, 16, 4)]
        return self.one(d, " ".join(parts), "-".join(parts), ".".join(parts), "  ".join(parts), "_".join(parts))

    def phone(self) -> str:
        a, b, c = self.of(_DIGIT[2:], 3), self.of(_DIGIT, 3), self.of(_DIGIT, 4)
        return self.one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+1 ({a}) {b}-{c}", f"+{self.of(_DIGIT[1:], 2)} {b} {c}", f"0{a[:2]} {b} {c}",
                        f"00{self.of(_DIGIT[1:], 2)} {a} {b}{c[:2]}", f"1-800-{b}-{c}")

    def secret(self) -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what follows."""
        key = self.r.choice(KEYS)
        value = self.one(self.of(_HEX, self.r.choice([16, 18, 24, 32, 40, 64])), self.of(_MIXED, self.r.randrange(12, 40)), self.of(_LOWER + _DIGIT, self.r.randrange(10, 30)))
        bare = self.one("AKIA" + self.of(_UPPER + "234567", 16), "ASIA" + self.of(_UPPER + "234567", 16), "ghp_" + self.of(_MIXED, 36), "sk-" + self.of(_MIXED, 40),
                        "xoxb-" + self.of(_DIGIT, 11) + "-" + self.of(_MIXED, 20), "AIza" + self.of(_MIXED, 35), f"eyJ{self.of(_MIXED, 20)}.eyJ{self.of(_MIXED, 30)}.{self.of(_MIXED, 30)}")
        return self.r.choice([("", f"{key}={value}", ""), (f"{key} = ", f'"{value}"', ""), (f"{key}: ", value, ""), (f"{key} is ", value, "."), ("", f"{key}={value}", ";"),
                              ("", bare, ""), ("", bare, ","), (f"{key} ", bare, "")])

    def nothing(self) -> str:
        """Numbers and codes that are nothing personal."""
        d = lambda n: self.of(_DIGIT, n)
        plain = "3" + d(15)
        return self.one(
            d(1), d(2), d(3), d(5), f"{1900 + self.r.randrange(130)}", f"{d(1)}.{d(1)}", f"version {d(1)}.", f"version {d(1)}.{d(1)}.{d(1)}", f"CC BY-NC {d(1)}.0.", f"{d(2)}%",
            f"${d(3)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"20{d(2)}-0{self.r.randrange(1, 10)}-1{d(1)}", f"1{d(1)}:{self.r.randrange(10, 60)}", f"pages {d(2)}-{d(3)}", f"no. {d(6)}",
            f"({d(4)})", f"[{d(2)}]", f"@{self.r.choice(NAMES)}", f"B{d(2)}", f"commit {self.of(_HEX, 40)}", f"sha256 {self.of(_HEX, 64)}", f"revision {self.of(_HEX, 12)}",
            f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"order {d(8)}", f"{plain if not luhn(plain) else plain[:-1] + str((int(plain[-1]) + 1) % 10)}", f"at {d(1)} dot {d(1)}",
            "the token of the day", "a secret place", "password rules", "the key is here", f"{d(3)}.", f"{d(2)},", f"x{d(1)}", f"{d(1)}st", f"{d(1)}th", f"{d(5)}-{d(4)}",
            "-" * 8 + d(2), f"{d(1)}:{d(1)}", f"{d(1)}/{d(1)}", f"A{d(1)}-{d(3)}")

    def words(self, least: int, most: int) -> str:
        def word() -> str:
            own = "".join(self.r.choice(["th", "er", "ion", "an", "re", "st", "ou", "en", "is", "lich", "eau", "ment", "ció", "ble"]) for _ in range(self.r.randrange(1, 4)))
            return self.r.choice(PLAIN) if self.r.random() < 0.5 else own
        out = [word() + (self.one(",", ".", ":") if self.r.random() < 0.15 else "") for _ in range(self.r.randrange(least, most))]
        return " ".join(w.capitalize() if self.r.random() < 0.1 else w for w in out)


def table(rows: int = 1500, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """Labelled sentences: a text and its spans (kind, start, end); the same for the same seed."""
    w, out = _Writer(seed), []
    simple: dict[str, Callable[[], str]] = {"email": w.email, "ip": w.ip, "card": w.card, "phone": w.phone}
    cues = {"email": WRITE, "phone": CALL, "ip": ["host", "server", "from"], "card": ["card", "visa", "pay"]}
    for _ in range(rows):
        text, spans = w.words(0, 6), []
        for _ in range(w.r.choice([1, 1, 1, 2])):
            text += " " if text else ""
            kind = w.r.choice(["", "", "", "", "email", "ip", "card", "phone", "secret"])
            if kind == "secret":
                before, value, after = w.secret()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
                text += before + value + after
            elif kind:
                if w.r.random() < 0.3:
                    text += w.r.choice(cues[kind]) + w.one(" ", ": ", " ")
                value = simple[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + w.one("", "", "", ".", ",", ")")
            else:
                text += w.nothing()
            text += " " + w.words(1, 6)
        out.append((text, spans))
    return out
