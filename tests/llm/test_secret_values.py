import random
import string
import time

import pytest

from assay.llm import secret_scan


@pytest.mark.parametrize(
    "name, value, form",
    [("DB_PWD", "Tr0ub4dorX9", "{}={}"), ("passphrase", "correcthorse9", "{}: {}"), ("credential", "Zx81kQpLm4Tz", "{}={}"), ("privateKey", "aB3dE5gH" * 200, "<{0}>{1}</{0}>"), ("x" * 200 + "_pwd", "Tr0ub4dorX9", "{}={}")],
)
def test_unquoted_and_long_values_are_found(name, value, form):
    t = form.format(name, value)
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in secret_scan.secrets(t.encode())] == [("literal", value)]


def test_known_names_and_calls_are_not_values():
    t = 'pw = "Tr0ub4dorX9"\nDB_PWD=pw\nuser_pwd = read_from_terminal("prompt")\n'
    assert [t[s["start"] : s["end"]] for s in secret_scan.secrets(t.encode())] == ["Tr0ub4dorX9"]


@pytest.mark.parametrize(
    "t, values",
    [
        ('pwd: str = "Tr0ub4dorX9"', ["Tr0ub4dorX9"]),
        ('x_pwd = """\n  Tr0ub4dorX9\n"""', ["Tr0ub4dorX9"]),
        ("pwd = rb'Tr0ub4dorX9'", ["Tr0ub4dorX9"]),
        ('pwd = /* old */ "Tr0ub4dorX9"', ["Tr0ub4dorX9"]),
        ("a:\n  private_pwd: |\n    aB3dE5gHxx\n\n    Zx81kQpLm4\n  next: Zx81kQpLm4", ["aB3dE5gHxx", "Zx81kQpLm4"]),
        ('conn.setPassword("Tr0ub4dorX9")', ["Tr0ub4dorX9"]),
        ('p.put("db.pwd", "Tr0ub4dorX9")', ["Tr0ub4dorX9"]),
        ('base = "Tr0ub4dor"\ndb_pwd = base + "X7kQ"', ["Tr0ub4dor", "X7kQ"]),
        ('db_pwd = f"{base}X7kQ"\nbase = "Tr0ub4dor"', ["X7kQ", "Tr0ub4dor"]),
        ('a=b\nb=c\nc="Tr0ub4dorX9"\nmy_pwd=a', ["Tr0ub4dorX9"]),
        ('x_pwd = "Tr0ub" "4dorX9"', ["Tr0ub", "4dorX9"]),
        ('DB_PWD="${BASE}Tr0ub4dorX9"', ["Tr0ub4dorX9"]),
        ("passphrase: c2VjcmV0UGFzc= old", ["c2VjcmV0UGFzc="]),
        ("a=b\nb=a\npwd=a", []),
        ("DB_PWD=${ELSEWHERE}", []),
        ('my_pwd = "of three words"', []),
        ('note = "Tr0ub4dorX9"', []),
    ],
)
def test_values_by_syntax(t, values):
    found = [t[s["start"] : s["end"]] for s in secret_scan.secrets(t.encode()) if s["kind"] == "literal"]
    assert sorted(found) == sorted(values)


def test_a_literal_scores_by_the_most_sensitive_name_that_it_reaches():
    t = 'x = "Tr0ub4dorX9"\nauth = x\npwd = auth\n'
    assert [(s["name"], s["score"]) for s in secret_scan.secrets(t.encode())] == [("pwd", secret_scan.literal_score("Tr0ub4dorX9"))]


@pytest.mark.parametrize(
    "piece",
    ["pwd" + "a" * 50, "<pwd>" + "a" * 50, "pwd ", "<pwd>aaa</pw", 'x_pwd = x_pwd + "ab"\n', 'pwd="""', "pwd = /* ", "pwd: |\n  pwd: |\n", "pwd: a[", "pwd=b+", 'pwd=f"{', 'pwd="a"  ', "a=pwd;pwd=a;", 'pwd "a', "--pwd ", "pwd=a or ", "a, pwd, ", "name: pwd, ", "://a:", "pwd = (", "pwd /*", "Authorization: Bearer ", "pwd=a ? 'b", "pwd=get('a',"],
)
def test_long_texts_take_linear_time(piece):
    began = time.perf_counter()
    secret_scan.secrets((piece * (2_000_000 // len(piece))).encode())
    assert time.perf_counter() - began < 20


V = "Tr0ub4dorX9"


@pytest.mark.parametrize(
    "t, values",
    [
        (f'#define DB_PWD "{V}"', [V]),
        (f'db_pwd /* c */ = "{V}"', [V]),
        (f'pwd = ("{V}")', [V]),
        (f'pwd = ["{V}"]', [V]),
        (f'user, db_pwd = "administrator", "{V}"', [V]),
        (f'pwd = x if c else "{V}"', [V]),
        (f'pwd = c ? "{V}" : "Zx81kQpLm4"', [V, "Zx81kQpLm4"]),
        (f'pwd = os.getenv("DB", "{V}")', [V]),
        (f'pwd = cfg.pwd || "{V}"', [V]),
        (f'let pwd: &str = "{V}";', [V]),
        (f"let pwd: &'static str = \"{V}\";", [V]),
        (f'pwd -> "{V}"', [V]),
        (f"mysql --pwd {V} --host db", [V]),
        (f"mysql --db-pwd='{V}'", [V]),
        (f'pwd "{V}"', [V]),
        (f"url = postgres://admin:{V}@db.example.net/x", [V]),
        (f"Authorization: Bearer {V}", [V]),
        (f"- name: DB_PWD\n  value: {V}", [V]),
        (f'<add key="DbPwd" value="{V}"/>', [V]),
        ('pass: "correct horse battery staple"', ["correct horse battery staple"]),
        ('pass: "must have at least eight letters"', []),
        ("secret_santa = wonderland", []),
        ("password_hint = grandmother7", []),
        ("give the --pwd required by it", []),
        ("see https://user:password@host/", []),
        (f'other "{V}"', []),
        (f'{{"pwd": x, "note": "{V}"}}', []),
    ],
)
def test_values_of_further_syntax(t, values):
    found = [t[s["start"] : s["end"]] for s in secret_scan.secrets(t.encode()) if s["kind"] == "literal"]
    assert sorted(found) == sorted(values)


FORMS = ['{} = "{}"', "{}: '{}'", "{}={}", "export {}={}", "<{0}>{1}</{0}>", 'set("{}", "{}")', '#define {} "{}"', '{} = get("X", "{}")', 'x, {} = "a", "{}"', "run --{} {}", '{} = a or "{}"', '"{}": "{}",', "{}: |\n  {}\n", 'const {}: string = "{}";', "- name: {}\n  value: {}", '{} = ["{}"]']


def test_planted_secrets_among_plain_values():
    """All planted values are found, and no value of a plain name, over forms in random order."""
    rng = random.Random(7)
    names = {True: ["db_pwd", "userPassphrase", "CLIENT_CREDENTIAL", "signingKey", "auth_bearer", "svc-pwd"], False: ["colour", "userTitle", "HOST_NAME", "build", "svc-zone", "pwd_policy"]}
    lines, planted = [], set()
    for _ in range(4000):
        secret = rng.random() < 0.5
        name, value = rng.choice(names[secret]), "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(14, 30)))
        value = f"k{value[:-2]}7Q"
        form = rng.choice(FORMS)
        if "-" in name and form.startswith(("{} =", "x, ", "#define", "const", "export")):
            name = name.replace("-", "_")
        lines.append(form.format(name, value))
        if secret:
            planted.add(value)
    t = "\n".join(lines)
    found = {t[s["start"] : s["end"]] for s in secret_scan.secrets(t.encode()) if s["kind"] == "literal"}
    assert not planted - found and not found - planted
