"""A synthetic source tree derived from ``documents``: one file for each row, its content chosen by doc_id.

``TEMPLATES`` are small files with the findings that a reader of the rules expects of them, written by hand.
They serve as input here, as truth for the cross-engine checks, and as cases in the tests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import BIDI

#: Id and confidence of a check's findings where a template does not name its own.
DEFAULTS = {"pickle": "CWE-502", "eval_exec": "CWE-94", "command_injection": "CWE-78", "sql_injection": "CWE-89", "path_traversal": "CWE-22", "hardcoded_secrets": "CWE-798", "yaml_deserialize": "CWE-502", "xxe": "CWE-611", "ssrf": "CWE-918", "tempfile": "CWE-377", "symlink": "CWE-61", "redos": "CWE-1333", "assert_security": "CWE-617", "exec_driver_sql": "CWE-89", "supply_chain": "CWE-1104", "debug_mode": "CWE-489", "insufficient_logging": "CWE-778", "timing_attack": "CWE-208", "sensitive_exposure": "CWE-200", "null_byte": "CWE-158", "resource_limits": "CWE-770", "insecure_random": "CWE-338", "ssti": "CWE-1336", "crlf": "CWE-93", "ldap": "CWE-90", "weak_hash": "CWE-328", "open_redirect": "CWE-601", "log_injection": "CWE-117", "format_string": "CWE-134", "arbitrary_write": "CWE-73", "insecure_default": "CWE-453", "log_secrets": "CWE-532", "tls_verify": "CWE-295", "zipslip": "CWE-22", "hardcoded_tokens": "CWE-798", "weak_crypto": "CWE-327", "dependency_cve": "CWE-1104", "trojan_source": "CWE-1007", "request_timeout": "CWE-1088", "torch_load": "CWE-502", "ssh_host_key": "CWE-322", "except_pass": "CWE-391", "pandas_eval": "CWE-94", "numpy_load": "CWE-502", "pandas_pickle": "CWE-502", "numpy_load_lib": "CWE-114", "pandas_xml_xxe": "CWE-611", "pth_startup_hooks": "CWE-829", "parquet_arrow_deserialize": "CWE-502", "unbounded_pins": "CWE-1104", "model_file_load": "CWE-502", "decode_exec_chains": "CWE-94", "bind_all_interfaces": "CWE-1327", "weak_tls_version": "CWE-326", "legacy_pycrypto": "CWE-1104", "huggingface_unsafe_download": "CWE-1104", "unbounded_pydantic_field": "CWE-770"}
_SURE = frozenset("eval_exec insufficient_logging insecure_random format_string insecure_default request_timeout torch_load except_pass pandas_eval numpy_load parquet_arrow_deserialize decode_exec_chains huggingface_unsafe_download dependency_cve".split())
_UNSURE = frozenset("redos debug_mode timing_attack".split())


@dataclass(frozen=True)
class Expected:
    check: str
    line: int
    severity: str
    cwe: str
    confidence: str
    code: str


@dataclass(frozen=True)
class Template:
    text: str
    expected: tuple[Expected, ...]
    name: str = ""  # of a manifest or .pth file


def _t(text: str, expected: str = "", name: str = "", codes: dict[tuple[str, int], str] | None = None) -> Template:
    """expected: ``check line SEVERITY [CWE]`` items with semicolons between. codes: where a finding's code is not its line; for the first of a check on a line."""
    lines, out, codes = text.split("\n"), [], dict(codes or {})
    for item in filter(None, (x.strip() for x in expected.split(";"))):
        check, line, severity, *cwe = item.split()
        confidence = "HIGH" if check in _SURE else "LOW" if check in _UNSURE else "MEDIUM"
        out.append(Expected(f"check_{check}", int(line), severity, cwe[0] if cwe else DEFAULTS[check], confidence, codes.pop((check, int(line)), lines[int(line) - 1].strip())))
    return Template(text, tuple(out), name)


TEMPLATES: tuple[Template, ...] = (
    _t("x = 1\n\ny = x + 1"),
    _t("import pickle\nv = pickle.loads(b)\n# pickle.loads(b)\nw = shelve.open(p)", "pickle 2 CRITICAL; pickle 4 HIGH"),
    _t("eval(code)\nexec('1')\ncompile(src, 'f', 'exec')\ncompile('1', 'f', 'exec')\nre.compile(p)\n__import__(n)", "eval_exec 1 CRITICAL; eval_exec 2 CRITICAL; eval_exec 3 CRITICAL; eval_exec 6 HIGH"),
    _t("import os\nos.system(cmd)\nsubprocess.run(cmd, shell=True)\nsubprocess.Popen(a)", "command_injection 2 CRITICAL; command_injection 3 HIGH; command_injection 3 HIGH; command_injection 4 HIGH"),
    _t('def f(cur, t):\n    cur.execute(f"SELECT * FROM {t}")\n    cur.execute("a" + t)', "sql_injection 2 CRITICAL; sql_injection 3 CRITICAL"),
    _t('TABLE = "users"\n\n\ndef f(cur):\n    cur.execute(f"SELECT * FROM {TABLE}")'),
    _t('def f(con, t):\n    con.exec_driver_sql(f"DROP {t}")\n\n\nNAME = "a"\n\n\ndef g(con):\n    con.exec_driver_sql(f"DROP {NAME}")', "sql_injection 2 CRITICAL; exec_driver_sql 2 CRITICAL"),
    _t("p = name.lstrip('/')\nwith open(relative_path) as f:\n    pass", "path_traversal 1 HIGH; path_traversal 2 MEDIUM"),
    _t('PASSWORD = "hunter22"\npassword = "your-password"\nssh_key = "abc"\nconnection_url = "db://u:p@h"', "hardcoded_secrets 1 HIGH; hardcoded_secrets 3 CRITICAL; hardcoded_secrets 4 CRITICAL"),
    _t("a = yaml.load(f)\nb = yaml.load(f, Loader=yaml.SafeLoader)\nc = yaml.unsafe_load(f)", "yaml_deserialize 1 CRITICAL; yaml_deserialize 3 CRITICAL"),
    _t("import xml.etree.ElementTree as ET\nfrom lxml import etree as E\nt = E.parse(f)\ns = xml.sax.make_parser()", "xxe 1 HIGH; xxe 3 HIGH; xxe 4 HIGH"),
    _t("import requests\n\n\ndef f(url):\n    return requests.get(url, timeout=3)\n\n\ndef g():\n    return requests.get('http://localhost/', timeout=3)", "ssrf 5 HIGH"),
    _t("import requests\n\n\ndef f(url):\n    session = requests.Session()\n    return session.get(url)\n\n\ndef g(session, o):\n    return session.delete(o)", "ssrf 6 HIGH"),
    _t("import httpx\n\n\nasync def f(url):\n    async with httpx.AsyncClient() as client:\n        return await client.get(url)", "ssrf 6 HIGH"),
    _t("n = tempfile.mktemp()\na.symlink_to(b)\nos.symlink(a, b)", "tempfile 1 HIGH; symlink 2 MEDIUM; symlink 3 MEDIUM"),
    _t("r = re.compile('(a+)+')\nr = re.compile('a+')", "redos 1 MEDIUM"),
    _t("assert user.role in roles\nassert user.role == 'x'\nassert isinstance(role, str) in a\nassert x in y", "assert_security 1 MEDIUM"),
    _t("a = '--extra-index-url http://x'\napp.run(debug=True)\n# app.run(debug=True)", "supply_chain 1 HIGH; debug_mode 2 MEDIUM"),
    _t("try:\n    f()\nexcept Exception:\n    return_code = 1\ntry:\n    f()\nexcept Exception as e:\n    print(e)\ntry:\n    f()\nexcept ValueError:\n    x = 1\ntry:\n    f()\nexcept:\n    log.info('x')", "insufficient_logging 3 LOW"),
    _t("ok = token == 'abc'\nif a == 'abc':\n    pass\ntraceback.print_exc()", "timing_attack 1 LOW; sensitive_exposure 4 MEDIUM"),
    _t("z = 'a\\x00b'\nd = f.read()\nd = f.read(10)\nd = r.stream.read()", "null_byte 1 INFO; resource_limits 2 INFO"),
    _t("import random\na = random.randint(1, 6)\nb = random.SystemRandom()\nc = x.random.choice(y)\nd = random.gauss(0, 1)", "insecure_random 2 LOW"),
    _t("t = Template(s)\nh = 'a\\r\\nb'\nc = ldap.initialize(u)\nimport ldap3", "ssti 1 HIGH; crlf 2 HIGH; ldap 3 HIGH; ldap 4 HIGH"),
    _t("h = hashlib.md5(b)\nh = hashlib.new('SHA1', b)\nh = hashlib.sha256(b)", "weak_hash 1 MEDIUM; weak_hash 2 MEDIUM"),
    _t("return redirect(url)\nshutil.move(a, b)", "open_redirect 1 MEDIUM; arbitrary_write 2 MEDIUM"),
    _t("log.info(f\"{a}\")\nlog.info(f\"{a} %s\")\nlog.info('x %s', a)\nlog.info(password)", "log_injection 1 LOW; log_secrets 4 HIGH"),
    _t("a = str.format(t, b)\nb = t.format(b)\nc = str.format('a')", "format_string 1 MEDIUM"),
    _t("np.load(\n    p,\n    allow_pickle=True,\n)\nallow_pickle = True\n\n\ndef f(\n    p,\n    allow_pickle=True,\n):\n    x: int = 1", "insecure_default 3 HIGH; insecure_default 5 HIGH; insecure_default 10 HIGH; numpy_load 1 HIGH"),
    _t("r.get(u, verify=False)\nc.check_hostname = False\nm = ssl.CERT_NONE\nc = ssl._create_unverified_context()", "tls_verify 1 CRITICAL; tls_verify 2 CRITICAL; tls_verify 3 CRITICAL; tls_verify 4 CRITICAL"),
    _t("z.extractall(p)\nz.extractall(p.resolve())", "zipslip 1 HIGH"),
    _t('API_KEY = "abcdefghij0123456789"\nbearer = "abcdefghij0123456789"\nclient_secret = "abcdefghij0123456789"\ntoken = os.environ["abcdefghij0123456789"]', "hardcoded_tokens 1 CRITICAL; hardcoded_tokens 2 CRITICAL; hardcoded_tokens 3 CRITICAL"),
    _t("c = ARC4.new(k)\nm = AES.MODE_ECB\nh = hashlib.md5 (password)\np = PKCS1_v1_5.new(k)", "weak_crypto 1 HIGH; weak_crypto 2 HIGH; weak_crypto 3 HIGH; weak_crypto 4 HIGH; weak_hash 3 MEDIUM"),
    _t("dask==2024.1.0\nrequests>=2.31.0\npandas==2.2.1\n# urllib3==1.26.0\naiohttp[speedups]==3.0.0", "dependency_cve 1 HIGH; dependency_cve 2 HIGH; dependency_cve 4 HIGH", "requirements.txt"),
    _t('[project]\nrequires-python = ">=3.10"\ndependencies = [\n    "pytest>=9.0",\n    "rich>=1.0,<2",\n    "python>=3.10",\n]', "unbounded_pins 4 LOW", "pyproject.toml"),
    _t(f"# a{BIDI[4]}b\nx = 1", "trojan_source 1 CRITICAL", codes={("trojan_source", 1): '"# a\\u{202e}b"'}),
    _t("import requests\nrequests.post('http://localhost/', 1)\nrequests.get('http://localhost/', timeout=1)\nrequests.sessions.get(u)", "request_timeout 2 HIGH"),
    _t("m = torch.load(p)\nn = torch.load(p, weights_only=True)\no = torch.load('m.pt')\nq = torch.load('m.pt', weights_only=True)", "torch_load 1 CRITICAL; torch_load 3 CRITICAL; model_file_load 3 CRITICAL; model_file_load 4 LOW"),
    _t("c.set_missing_host_key_policy(AutoAddPolicy())\nWarningPolicy\nsshtunnel.open_tunnel(h)", "ssh_host_key 1 HIGH; ssh_host_key 2 HIGH; ssh_host_key 3 HIGH"),
    _t("try:\n    f()\nexcept ValueError:\n    pass\nfor i in a:\n    try:\n        f()\n    except Exception:\n        continue", "except_pass 3 MEDIUM; except_pass 8 MEDIUM; insufficient_logging 8 LOW"),
    _t("pd.eval(e)\ndf.query(q)\nquery(q)\ndf.f().query(q)", "pandas_eval 1 CRITICAL; pandas_eval 2 HIGH"),
    _t("numpy.load(p, allow_pickle=True)\nnp.load(p)\nd = pd.read_pickle(p)\nnumpy.ctypeslib.load_library('a.so', p)\npd.read_xml(f)\npd.read_xml(f, parser='etree')", "insecure_default 1 HIGH; numpy_load 1 HIGH; pandas_pickle 3 CRITICAL; numpy_load_lib 4 HIGH; pandas_xml_xxe 5 HIGH"),
    _t("site.addsitedir(p)\nexec(open('a.pth').read())", "pth_startup_hooks 1 HIGH; pth_startup_hooks 2 CRITICAL; eval_exec 2 CRITICAL; resource_limits 2 INFO"),
    _t("\n# comment\nimport os; os.system('x')\nimport sys", "pth_startup_hooks 3 CRITICAL; command_injection 3 CRITICAL", "start.pth"),
    _t("class E:\n    def __arrow_ext_deserialize__(self, s):\n        return cloudpickle.loads(s)\n\n\nt = cloudpickle.loads(parquet_meta)", "parquet_arrow_deserialize 2 CRITICAL; parquet_arrow_deserialize 6 CRITICAL; pickle 3 CRITICAL; pickle 6 CRITICAL"),
    _t("m = joblib.load('m.pkl')\nk = keras.models.load_model(p)", "pickle 1 HIGH; model_file_load 1 HIGH; model_file_load 2 HIGH"),
    _t("a = base64.b64decode(x)\nb = zlib.decompress(a)\nexec(b)\nexec(a)\nexec(base64.b64decode(x))", "decode_exec_chains 3 CRITICAL; decode_exec_chains 4 CRITICAL; decode_exec_chains 5 CRITICAL; decode_exec_chains 5 CRITICAL; eval_exec 3 CRITICAL; eval_exec 4 CRITICAL; eval_exec 5 CRITICAL", codes={("decode_exec_chains", 3): "decode at line 2, exec at line 3", ("decode_exec_chains", 4): "decode at line 1, exec at line 4", ("decode_exec_chains", 5): "decode at line 5, exec at line 5"}),
    _t("s.bind(('0.0.0.0', 80))\nv = ssl.PROTOCOL_TLSv1\nw = ssl.PROTOCOL_TLSv1_2\nfrom Crypto.Cipher import AES\nfrom Cryptodome.Cipher import AES", "bind_all_interfaces 1 MEDIUM; weak_tls_version 2 HIGH; legacy_pycrypto 4 MEDIUM"),
    _t("a = M.from_pretrained(n)\nb = M.from_pretrained(n, revision='abc')\nc = M.from_pretrained(n, trust_remote_code=True)\nd = load_dataset(n)\ne = pipeline(n, trust_remote_code=True)", "huggingface_unsafe_download 1 MEDIUM; huggingface_unsafe_download 3 CRITICAL CWE-94; huggingface_unsafe_download 5 CRITICAL CWE-94"),
    _t("class LoginRequest(BaseModel):\n    name: str\n    note: Optional[str] = None\n    age: int\n    tag: Annotated[str, Field(max_length=5)]\n    code: str = Field(max_length=3)\n    body: bytes | None = None\n\n\nclass Settings(BaseModel):\n    name: str", "unbounded_pydantic_field 2 MEDIUM; unbounded_pydantic_field 3 MEDIUM; unbounded_pydantic_field 7 MEDIUM"),
    _t("eval(a)  # nosec\npickle.loads(b)  # nosec CWE-94\npickle.loads(b)  # nosec CWE-502,CWE-94\nn = tempfile.mktemp()  # nosec -- why\nd = f.read()  # NOSEC: fine", "eval_exec 1 CRITICAL; pickle 2 CRITICAL; pickle 3 CRITICAL; tempfile 4 HIGH; resource_limits 5 INFO"),
    _t("def broken(:\n    eval(x)\n    v = pickle.loads(b)", "pickle 3 CRITICAL"),
)

COUNT = len(TEMPLATES)


def spread(df: DataFrame) -> DataFrame:
    """A small table in few parts is dealt to all cores; one in many parts stays as it is."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= most else df.repartition(most)


def files(documents: DataFrame) -> DataFrame:
    """``schema.FILES`` of the synthetic tree, one file for each row with an id."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("doc_id"), F.lit(COUNT)) + 1).cast("int"))
    d = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")))
    number = F.col("doc_id").cast("string")
    package = F.concat(F.lit("pkg"), F.pmod("doc_id", F.lit(5)).cast("string"))
    tests = F.when(F.pmod("doc_id", F.lit(7)) == 0, "tests/").otherwise("")
    own = pick([t.name for t in TEMPLATES])
    name = F.when(own == "", F.concat(F.lit("mod_"), number, F.lit(".py"))).otherwise(own)
    file = F.concat(package, F.lit("/"), tests, F.when(own == "", "").otherwise(F.concat(F.lit("d"), number, F.lit("/"))), name)
    path = F.concat(F.lit("/repo/"), file)
    text = F.concat(pick([t.text for t in TEMPLATES]), F.lit("\n# document "), number, F.lit("\n"))
    return d.select(path.alias("path"), F.split(path, "/").alias("path_key"), file.alias("file"), package.alias("package"), name.alias("name"), F.substring_index(name, ".", -1).alias("ext"), text.alias("text"), (F.pmod("doc_id", F.lit(3)) == 0).alias("locked"))


def packages(documents: DataFrame) -> DataFrame:
    """(package, root): a package for each row, its root three directories below the workspace /repo."""
    d = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return d.select(F.expr("concat('p', doc_id)").alias("package"), F.expr("concat('/repo/pkg', doc_id % 5, '/g', doc_id % 37, '/d', doc_id)").alias("root"))


def listing(documents: DataFrame) -> DataFrame:
    """(dir, name) of manifests and lock files in the directories of ``packages`` and above them."""
    d = documents.where("doc_id is not null").select(F.expr("CAST(doc_id AS long)").alias("doc_id"))
    one = lambda where, name, there: f"named_struct('dir', concat({where}), 'name', {name}, 'there', {there})"
    top, group = "'/repo/pkg', doc_id % 5", "'/repo/pkg', doc_id % 5, '/g', doc_id % 37"
    each = (
        one(f"{group}, '/d', doc_id", "element_at(array('pyproject.toml', 'uv.lock', 'notes.md'), CAST(doc_id % 3 + 1 AS int))", "doc_id % 11 < 3"),
        one(group, "'requirements.txt'", "doc_id % 37 % 3 = 0"),
        one(group, "'setup.py'", "doc_id % 37 % 6 = 0"),
        one(group, "'poetry.lock'", "doc_id % 37 % 4 = 0"),
        one(top, "'Pipfile'", "doc_id % 5 % 2 = 0"),
        one(top, "'Pipfile.lock'", "doc_id % 5 = 4"),
        one("'/repo'", "'pyproject.toml'", "true"),
    )
    found = F.expr(f"array({', '.join(each)})")
    return d.select(F.explode(found).alias("f")).where("f.there").select("f.dir", "f.name").distinct()


def requirements(documents: DataFrame) -> DataFrame:
    """``schema.FILES`` of a requirements.txt for each row, with versions that follow from its number."""
    d = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")))
    text = F.expr("""concat('# ', doc_id, '\\nlib', doc_id % 7, '==', doc_id % 5, '.', doc_id % 11, '.', doc_id % 3, '\\nLIB', (doc_id + 3) % 9, ' >= ', doc_id % 4, '.', doc_id % 13, '.0',
        '\\nlib', (doc_id + 1) % 9, '[extra]==1.0.0\\nlib', doc_id % 7, '==', (doc_id + 1) % 5, '.0.1\\n')""")
    path = F.expr("concat('/repo/d', doc_id, '/requirements.txt')")
    return d.select(path.alias("path"), F.split(path, "/").alias("path_key"), F.expr("concat('d', doc_id, '/requirements.txt')").alias("file"), F.lit("d").alias("package"), F.lit("requirements.txt").alias("name"), F.lit("txt").alias("ext"), text.alias("text"), F.lit(False).alias("locked"))


def advisories(supplier: DataFrame) -> DataFrame:
    """``advisories.SCHEMA``: one for each supplier; some without a lower or an upper bound, some with bounds that are none."""
    return supplier.select(
        F.expr("concat('lib', s_suppkey % 9)").alias("dependency"),
        F.expr("CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(s_suppkey % 3, '.', s_suppkey % 10, '.0') ELSE concat(s_suppkey % 2, '.0.', s_suppkey % 5) END").alias("introduced"),
        F.expr("CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(s_suppkey % 4, '.', s_suppkey % 12) ELSE concat(s_suppkey % 4 + 1, '.', s_suppkey % 12, '.2') END").alias("fixed"),
        F.expr("concat('ADV-', s_suppkey)").alias("advisory"),
    )


def texts(table: DataFrame, *key: str) -> DataFrame:
    """``schema.FILES`` of the whole texts of a table, as plain text files named by its key (whole numbers), each followed
    by a template chosen by its first number."""
    chosen = F.element_at(F.array(*[F.lit(t.text) for t in TEMPLATES]), (F.pmod(F.col(key[0]), F.lit(COUNT)) + 1).cast("int"))
    name = F.concat_ws("-", *[F.col(k).cast("string") for k in key])
    file = F.concat(name, F.lit(".txt"))
    return spread(table.select(*key, "text")).select(file.alias("path"), F.array(file).alias("path_key"), file.alias("file"), F.lit("texts").alias("package"), file.alias("name"), F.lit("txt").alias("ext"), F.concat_ws("\n", F.col("text").cast("string"), chosen).alias("text"), F.lit(False).alias("locked"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same tree in SQL: ``tree`` (doc_id, tmpl, package, file), ``tpl`` (tmpl, line_no, line), ``truth``.
SQL_TREE = f"""names(tmpl, name) AS (VALUES {', '.join(f'({k}, {_q(t.name)})' for k, t in enumerate(TEMPLATES))}),
tree AS (SELECT doc_id, tmpl, concat('pkg', doc_id % 5) AS package,
  concat('pkg', doc_id % 5, '/', CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END,
         CASE WHEN name = '' THEN concat('mod_', doc_id, '.py') ELSE concat('d', doc_id, '/', name) END) AS file
  FROM documents JOIN names ON tmpl = doc_id % {COUNT})"""
SQL_LINES = f"""tpl(tmpl, line_no, line) AS (VALUES {', '.join(f'({k}, {n}, {_q(x)})' for k, t in enumerate(TEMPLATES) for n, x in enumerate(t.text.split(chr(10)), 1))})"""
SQL_TEMPLATES = f"""templates(tmpl, body) AS (VALUES {', '.join(f'({k}, {_q(t.text)})' for k, t in enumerate(TEMPLATES))})"""
SQL_TRUTH = f"""truth(tmpl, check_id, line, severity, cwe_id, confidence, code, source) AS (VALUES {', '.join(f'({k}, {_q(e.check)}, {e.line}, {_q(e.severity)}, {_q(e.cwe)}, {_q(e.confidence)}, {_q(e.code)}, {_q(t.text.split(chr(10))[e.line - 1])})' for k, t in enumerate(TEMPLATES) for e in t.expected)}),
found AS (SELECT file, package, CAST(line AS INTEGER) AS line, check_id,
  CASE WHEN check_id = 'check_unbounded_pins' AND doc_id % 3 = 0 THEN 'INFO' ELSE severity END AS severity, cwe_id, confidence, code, source FROM tree JOIN truth USING (tmpl))"""
