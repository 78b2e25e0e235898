"""Made-up secrets and look-alikes, to be planted into windows of real text that a tagger learns from."""

from __future__ import annotations

import string
from random import Random

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALNUM, BASE64, URLSAFE = UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"

# How tokens of well-known services begin, with the letters and the length of what follows.
SERVICES = [
    ("ghp_", ALNUM, 36), ("gho_", ALNUM, 36), ("github_pat_", ALNUM, 60), ("glpat-", URLSAFE, 20), ("sk-", ALNUM, 48), ("sk_live_", ALNUM, 24), ("pk_test_", ALNUM, 24), ("xoxb-", DIGITS + "-", 24), ("AIza", URLSAFE, 35),
    ("npm_", ALNUM, 36), ("hf_", ALNUM, 34), ("dop_v1_", LOWER + DIGITS, 64), ("ya29-", URLSAFE, 60), ("ASIA", UPPER + DIGITS, 16), ("EAAC", ALNUM, 80), ("rk_live_", ALNUM, 24), ("key-", LOWER + DIGITS, 32), ("SG-", URLSAFE, 60),
]
# What secrets are called, beside the names that the fixed patterns know.
NAMES = (
    "pwd pass passphrase passcode psw PGPASSWORD db_pass admin_pass root_pwd user_pwd auth auth_key access_key access-key private_key client_key signing_key encryption_key master_key secret_key consumer_key "
    "service_key license_key ssh_key credential credentials cred login_key session_key shared_key webhook_key storage_key bot_key deploy_key key apikey api-key"
).split()
SEPARATORS = (":", ": ", "=", " = ", " : ", " is ", ' = "', '="', ": '", '": "', "='")
WORDS = "hunter dragon summer winter monkey orange silver castle welcome admin river tiger falcon shadow sunshine coffee rocket purple guitar forest pepper marble".split()


def _some(r: Random, letters: str, n: int) -> str:
    return "".join(r.choices(letters, k=n))


def _mixed(r: Random, letters: str, low: int, high: int) -> str:
    """A run with a digit and a letter at least."""
    while True:
        out = _some(r, letters, r.randint(low, high))
        if any(c in DIGITS for c in out) and any(c in UPPER + LOWER for c in out) and out[0] not in "+/-_" and out[-1] not in "+/-_":
            return out


def _memorable(r: Random) -> str:
    parts = [r.choice(WORDS), _some(r, DIGITS, r.randint(1, 3)), _mixed(r, LOWER + DIGITS, 3, 7)]
    return (r.choice(("", "-", "_")).join(parts)).translate({} if r.random() < 0.5 else str.maketrans("aeo", "430"))


MARKS = "!@#$%&*?"
#: Pieces of names in programs.
PARTS = "get set is has make build read write parse load user item index node list map value page state event error request response client server factory manager handler provider service config option query cache table field format buffer".split()
ELEMENTS = "C H O N Na Cl Ca Fe Mg Si Al K S P Br Cu Zn".split()


def _marked(r: Random) -> str:
    """A password with marks in it or at its end."""
    parts = [r.choice(WORDS).capitalize(), _some(r, DIGITS, r.randint(1, 4)), _mixed(r, LOWER + DIGITS, 2, 4)]
    parts.insert(r.randint(1, 3), r.choice(MARKS))
    return "".join(parts) + r.choice(("", r.choice(MARKS)))


def _value(r: Random) -> str:
    kind = r.randrange(7)
    if kind == 0:
        return _memorable(r)
    if kind == 6:
        return _marked(r)
    if kind == 1:
        return _mixed(r, BASE64, 16, 44)
    if kind == 2:
        return _mixed(r, UPPER + DIGITS, 12, 40)
    if kind == 3:
        return _mixed(r, LOWER + DIGITS, 10, 40)
    return _mixed(r, ALNUM, 10, 44)


def _service(r: Random) -> str:
    start, letters, n = r.choice(SERVICES)
    return start + _mixed(r, letters if set(letters) & set(UPPER + LOWER) else letters + LOWER, n, n)


def secret(r: Random) -> tuple[str, str, str]:
    """(before, the secret itself, after)."""
    form = r.randrange(8)
    if form == 7:
        return f"{r.choice(WORDS)} {r.choice(('-p ', '-P ', '--pass ', '--pwd=', '--key ', '--auth=', '-a '))}", r.choice((_memorable(r), _marked(r), _mixed(r, ALNUM, 10, 30))), f" {r.choice(WORDS)}"
    if form <= 2:
        name, between = r.choice(NAMES), r.choice(SEPARATORS)
        name = r.choice((name, name, name.upper(), name.capitalize()))
        return name + between, _value(r), between[-1] if between[-1] in "'\"" else ""
    if form == 3:
        return r.choice(("", "", "use ", "token ", "key: ", '"')), _service(r), ""
    if form == 4:
        return r.choice(("Authorization: Bearer ", "Bearer ", "bearer ", "Authorization: token ", "-H 'X-Auth: ")), r.choice((_mixed(r, ALNUM, 24, 60), ".".join(("eyJ" + _mixed(r, URLSAFE, 15, 30), "eyJ" + _mixed(r, URLSAFE, 20, 60), _mixed(r, URLSAFE, 20, 43))))), ""
    if form == 5:
        return f"{r.choice(('postgres', 'mysql', 'https', 'redis', 'amqp', 'mongodb'))}://{r.choice(WORDS)}:", _mixed(r, ALNUM, 8, 20), f"@{r.choice(WORDS)}.example.com/{r.choice(WORDS)}"
    return "", _mixed(r, r.choice((ALNUM, ALNUM, BASE64)), 20, 40), ""


def harmless(r: Random) -> str:
    """Something that looks a little like a secret, or stands beside words that go with secrets, and is none."""
    words, name = r.sample(WORDS, 4), r.choice((*NAMES, "password", "token", "secret", "api_key"))
    parts = [x.capitalize() if r.random() < 0.9 else x.upper() for x in r.choices(PARTS + words, k=r.randint(3, 6))]
    parts.insert(r.randint(1, len(parts)), r.choice(("", "", "V2", "2", "3D", "Utf8", "64", "X509", "Md5", str(r.randint(1, 99)))))
    camel = "".join(parts)
    camel = r.choice((camel, camel[0].lower() + camel[1:]))
    call = f"{camel[:1].lower() + camel[1:]}({r.choice(words)},{_some(r, LOWER, 1)}{r.randint(0, 9)})"
    if r.random() < 0.5:  # as often as in programs
        return r.choice(
            (
                lambda: camel,
                lambda: camel,
                lambda: call,
                lambda: f"{r.choice(PARTS)}.{camel}.{r.choice(PARTS)}{r.randint(1, 9)}",
                lambda: f"new {camel}({words[0]})",
                lambda: f"{r.choice(PARTS)}{camel}({r.choice(WORDS)}, {words[0]}{r.choice(PARTS).capitalize()}{r.randint(1, 9)}, {words[1]}{r.choice(PARTS).capitalize()}{r.randint(1, 9)}): {r.choice(PARTS)}",
                lambda: f"{words[0]}{r.choice(PARTS).capitalize()}{r.randint(1, 9)}[{r.randint(0, 9)}] = {words[1]}{r.choice(PARTS).capitalize()}{r.randint(1, 9)};",
                lambda: f"{r.choice(PARTS)}_{r.choice(PARTS)}{r.randint(1, 99)}_{r.choice(words)}",
                lambda: f"data:{r.choice(('image', 'font', 'audio'))}/{r.choice(('png', 'gif', 'woff2', 'svg', 'wav'))};base64,{_some(r, BASE64, r.randint(40, 200))}{r.choice(('', '=', '=='))}",
                lambda: f"{_some(r, UPPER, 2)}{_some(r, DIGITS, 2)}{_some(r, UPPER, 4)}{_some(r, DIGITS, r.randint(8, 16))}",
                lambda: " ".join((_some(r, UPPER, 2) + _some(r, DIGITS, 2), *(_some(r, DIGITS, 4) for _ in range(4)))),
                lambda: "".join(f"{r.choice(ELEMENTS)}{r.choice(('', '2', '3', '4', str(r.randint(5, 40))))}" for _ in range(r.randint(2, 8))) + r.choice(("", "", "(SO4)3", "[CO3]2")),
                lambda: "-".join(_some(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
                lambda: f"{r.choice(WORDS)} {_some(r, '0123456789abcdef', r.randint(7, 12))}",
                lambda: f"{_some(r, LOWER, 1)}.{_some(r, LOWER, 1)}={_some(r, LOWER, 1)}=>{_some(r, LOWER, 2)}({_some(r, LOWER, 1)}{r.randint(0, 99)},{_some(r, LOWER, 1)}{r.randint(0, 9)});",
                lambda: f"{r.choice(PARTS)}{r.choice(PARTS).capitalize()}{_some(r, DIGITS, 2)}={r.choice(words)}{r.choice(PARTS).capitalize()}{r.randint(1, 99)}",
            )
        )()
    return r.choice(
        (
            lambda: words[0] + words[1].capitalize() + words[2].capitalize() + _some(r, DIGITS, r.randint(0, 3)),
            lambda: "_".join(words[: r.randint(2, 4)]) + r.choice(("", "_v3", "_2024", f"_{r.randint(1, 999)}", f"_{r.randint(1, 99)}")),
            lambda: "-".join(words[: r.randint(2, 4)]) + "-" + _some(r, DIGITS, r.randint(1, 5)),
            lambda: f"https://www.{words[0]}.example.com/{words[1]}/{r.randint(1, 99999)}/{words[2]}-{words[3]}-{r.randint(1, 999)}.html?page={r.randint(1, 99)}&ref={words[0]}{r.randint(1, 99)}",
            lambda: f"{words[0]}.{words[1]}{r.randint(1, 999)}@{words[2]}{r.randint(1, 99)}.example.org",
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}Z",
            lambda: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1990, 2030)}",
            lambda: f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}-{r.choice(('beta', 'rc', 'alpha'))}{r.randint(1, 9)}",
            lambda: f"+{_some(r, DIGITS, 2)}-{_some(r, DIGITS, 3)}-{_some(r, DIGITS, 4)}-{_some(r, DIGITS, 4)}",
            lambda: _some(r, DIGITS, r.randint(4, 15)),
            lambda: f"{_some(r, UPPER, r.randint(2, 4))}-{r.randint(1990, 2030)}-{_some(r, DIGITS, r.randint(4, 6))}",
            lambda: f"IMG_{r.randint(2000, 2030)}{_some(r, DIGITS, 4)}_{_some(r, DIGITS, 6)}.jpg",
            lambda: f"/{words[0]}/{words[1]}_{r.randint(1, 99)}/{words[2]}{r.randint(1, 99)}.py",
            lambda: f"{_some(r, LOWER, 8)}-{_some(r, DIGITS, 4)}-{_some(r, DIGITS, 4)}",
            lambda: f"{words[0]}{words[1]}{words[2]}{words[3]}",
            lambda: f"{words[0].upper()}_{words[1].upper()}_{words[2].upper()}",
            lambda: f"{name}{r.choice((': ', ' = ', ' is ', ' '))}{r.choice(('required', 'none', 'null', 'yes', 'changed', 'the', words[0], words[1], 'string', 'here', str(r.randint(1, 99))))}",
            lambda: f"the {name} of {words[0]} and {words[1]}",
            lambda: f"{words[0]} = {words[1]}{r.randint(1, 99)}",
            lambda: f'"{words[0]}": "{words[1]} {words[2]}"',
            lambda: f"ISBN 978-{_some(r, DIGITS, 1)}-{_some(r, DIGITS, 4)}-{_some(r, DIGITS, 4)}-{_some(r, DIGITS, 1)}",
            lambda: f"{words[0].capitalize()}{words[1].capitalize()}{words[2].capitalize()}Test{r.randint(1, 99)}",
            lambda: f"#{_some(r, LOWER, r.randint(3, 12))}{r.randint(1, 2030)}",
            lambda: f"{r.randint(1, 99)}{r.choice(('km', 'kg', 'px', 'MHz', 'th', 'GB'))} {r.randint(100, 9999)}x{r.randint(100, 9999)}",
        )
    )()
