from vigil.operators.extract import file_facts

from .demo import CACHE_MANAGER


def kinds(facts, kind):
    return [f for f in facts if f[1] == kind]


def test_suspicious_demo_facts():
    f = file_facts("cache_manager.py", CACHE_MANAGER)
    assert [x[2] for x in kinds(f, "import")] == ["base64", "socket", "subprocess"]
    calls = [(x[2], x[4]) for x in kinds(f, "call")]
    assert calls == [("base64.b64decode", 8), ("socket.socket", 9), ("s.connect", 10), ("s.send", 11),
                     ("subprocess.Popen", 12)]
    assert [(x[3], x[2]) for x in kinds(f, "func")] == [("<module>", "cache_manager.py:run")]
    assert all(x[3] == "cache_manager.py:run" for x in kinds(f, "call"))
    assert [x[7] for x in kinds(f, "string")] == ["127.0.0.1", "cHJpbnQoJ2hlbGxvJyk=", "cmd.exe", "/c", "whoami"]
    assert kinds(f, "block") == []


def test_syntax_error():
    f = file_facts("bad.py", "def send(\n    requests.post(url)\n")
    assert f[0][1] == "file" and f[0][7] is not None
    assert kinds(f, "error")[0][7].startswith("bad.py: ")
    assert len(f) == 2


def test_imports():
    assert [x[2] for x in kinds(file_facts("p.py", "import xml.dom.minidom"), "import")] == ["xml.dom.minidom", "xml"]
    assert kinds(file_facts("p.py", "from . import x"), "import") == []
    assert [x[2] for x in kinds(file_facts("p.py", "from .cache import f"), "import")] == ["cache"]


def test_call_names():
    assert [x[2] for x in kinds(file_facts("p.py", "get_loader()(p)"), "call")] == ["get_loader", "get_loader"]
    assert [x[2] for x in kinds(file_facts("p.py", 'modules["os"].system("w")'), "call")] == ["modules.system"]
    assert kinds(file_facts("p.py", "(lambda x: x)(f)"), "call") == []
    assert [x[2] for x in kinds(file_facts("p.py", '"".join(x)'), "call")] == ["join"]


def test_blocks():
    f = file_facts("p.py", "if a:\n  pass\nelif b:\n  pass\nelif c:\n  pass\n")
    b = kinds(f, "block")
    assert len(b) == 3 and sum(x[5] for x in b) == 6 and max(x[6] for x in b) == 3
    t = kinds(file_facts("p.py", "try:\n  a()\nexcept A:\n  pass\nexcept B:\n  pass\n"), "block")
    assert [x[5] for x in t] == [3]
    t = kinds(file_facts("p.py", "try:\n  a()\nfinally:\n  pass\n"), "block")
    assert [x[5] for x in t] == [2]


def test_method_scope():
    f = file_facts("p.py", "class A:\n def f(self): g()\n")
    assert [(x[3], x[2]) for x in kinds(f, "func")] == [("<module>", "p.py:f")]
    assert [(x[3], x[2]) for x in kinds(f, "call")] == [("p.py:f", "g")]


def test_strings_and_bom():
    f = file_facts("p.py", '"""d"""\nx = f"a{b}"\ny = b"x"\n')
    assert [x[7] for x in kinds(f, "string")] == ["d", "a"]
    assert file_facts("p.py", "\ufeffimport os")[0][7] is not None


def test_deep_nesting_is_an_error_row_not_a_crash():
    src = "x = " + "(" * 5000 + "1" + ")" * 5000
    f = file_facts("p.py", src)
    assert f[0][1] == "file"
