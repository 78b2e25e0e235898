"""Forms of secrets and of harmless text for tests of the scan, made without anything of the generator that the field learns from."""

from __future__ import annotations

import base64
import string

LETTERS, NUMBERS = string.ascii_letters, string.digits
TEXT = "we walked along the shore until the boats came in and the market opened again near the bridge".split()
SYLLABLES = "ba ri ton ve lu mar sed ko pil dan er ous tra mi gel fo".split()


def noise(r, n, letters=LETTERS + NUMBERS):
    while True:
        out = "".join(r.choice(letters) for _ in range(n))
        if any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
            return out


def around(r, text):
    """(the text between words, where it begins)"""
    before = " ".join(r.choice(TEXT) for _ in range(r.randint(5, 30))) + " "
    return before + text + " " + " ".join(r.choice(TEXT) for _ in range(r.randint(5, 30))), len(before)


SECRETS = {
    "client_secret_value": lambda r: ("client_secret_value: ", noise(r, 32), ""),
    "whsec": lambda r: ("", "whsec_" + noise(r, 32), ""),
    "sid": lambda r: ("", "SK" + noise(r, 32, "0123456789abcdefABCDEF"), ""),
    "env": lambda r: (f"export {r.choice(('DB', 'MAIL', 'FTP'))}_PASSWD_FILE -> ", noise(r, 16), ""),
    "json": lambda r: ('{"user": "ann", "pass": "', noise(r, 14), '"}'),
    "option": lambda r: ("sshpass -p ", noise(r, 14), " ssh host"),
    "dotted": lambda r: ("", ".".join(noise(r, n, LETTERS + NUMBERS + "_-").strip("_-") for n in (24, 40, 43)), ""),
    "azure": lambda r: ("AccountKey=", noise(r, 64, LETTERS + NUMBERS + "+/").strip("+/"), ";Endpoint"),
    "header": lambda r: ("X-Api-Auth: ", noise(r, 40), ""),
    "url": lambda r: ("ftp://backup:", noise(r, 16), "@files.example.net/store"),
}


def _syllables(r, n):
    return "".join(r.choice(SYLLABLES) for _ in range(n))


HARMLESS = {
    "camel": lambda r: "".join(_syllables(r, r.randint(2, 3)).capitalize() for _ in range(r.randint(2, 4))) + r.choice(("", "V2", "3", "64")) + r.choice(("Factory", "Impl", "Test", "Proxy")),
    "camel lower": lambda r: _syllables(r, 2) + "".join(_syllables(r, 2).capitalize() for _ in range(3)) + str(r.randint(1, 9)) + _syllables(r, 2).capitalize(),
    "snake": lambda r: "_".join(_syllables(r, r.randint(1, 3)) for _ in range(3)) + f"_{r.randint(1, 99)}",
    "image data": lambda r: "src=data:image/jpeg;base64," + base64.b64encode(r.randbytes(r.randint(60, 240))).decode(),
    "iban": lambda r: r.choice(("GB", "NL", "CH")) + f"{r.randint(10, 99)}" + r.choice(("BARC", "INGB", "UBSW")) + "".join(r.choice(NUMBERS) for _ in range(14)),
    "formula": lambda r: "".join(f"{x}{r.randint(2, 30)}" for x in r.sample(["C", "H", "N", "O", "Cl", "Na"], 4)) + "(OH)2",
    "uuid": lambda r: "-".join(f"{r.getrandbits(4 * n):0{n}x}" for n in (8, 4, 4, 4, 12)),
    "mac": lambda r: ":".join(f"{r.getrandbits(8):02X}" for _ in range(6)),
    "part number": lambda r: f"{r.choice('ABX')}{r.randint(100, 999)}-{r.randint(10, 99)}{r.choice('KLM')}/{r.randint(1, 9)}",
    "doi": lambda r: f"10.{r.randint(1000, 9999)}/j.{_syllables(r, 2)}.{r.randint(1990, 2024)}.{r.randint(1, 12):02d}.{r.randint(1, 999):03d}",
    "minified": lambda r: f"function({r.choice('abc')},{r.choice('xyz')}){{return {r.choice('abc')}.{_syllables(r, 2)}{_syllables(r, 1).capitalize()}({r.randint(1, 99)})}}",
    "plate": lambda r: f"{r.choice('ABC')}{r.choice('DEF')} {r.randint(10, 99)} {r.choice('GHJ')}{r.choice('KLM')}{r.choice('NPR')}",
    "import": lambda r: f"import {{ {_syllables(r, 2)}{_syllables(r, 2).capitalize()} }} from '@{_syllables(r, 2)}/{_syllables(r, 2)}-v{r.randint(1, 9)}'",
    "model": lambda r: f"{_syllables(r, 2).capitalize()} {r.choice('XTR')}{r.randint(10, 99)}0{r.choice(('i', 's', ' Pro', 'G5'))}",
}
