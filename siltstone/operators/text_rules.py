"""The 41 line checks, and the line halves of the two mixed ones."""

from __future__ import annotations

from siltstone.operators.rules import Has, Named, Rx, TextCheck, Variant, any_of

# Ids, names and severities of findings, and the patterns that define them.

_CMD_CRITICAL = ("os.system", "os.popen")
_CMD_HIGH = ("subprocess.call", "subprocess.Popen", "subprocess.run", "subprocess.check_output", "subprocess.getoutput", "subprocess.getstatusoutput", "os.execv", "os.execl", "os.execve", "os.execvp", "pty.spawn", "asyncio.create_subprocess_shell")
_LOG = "debug|info|warning|warn|error|critical|exception|log"


def _placeholder(on: str = "lower"):
    """Values that only look like secrets."""
    tokens = ("environ", "getenv", "config", "your-", "placeholder", "...", "example", "xxxx", "****")
    url = Has("connection_url", on) & any_of(Has("{"), Has("}"), Has("dialect", on))
    return any_of(*(Has(t, on) for t in tokens), url)


def _call(name: str) -> Rx:
    return Rx(r"\b" + name.replace(".", r"\.") + r"\s*\(")


def _variants(check: str, cwe: str, cwe_name: str, *rows: tuple, **more) -> tuple[Variant, ...]:
    """rows: (severity, condition, detail)."""
    return tuple(Variant(check, cwe, cwe_name, sev, detail, when, **more) for sev, when, detail in rows)


def _one(check: str, cwe: str, cwe_name: str, severity: str, when, detail: str, live: bool = True, **more) -> TextCheck:
    return TextCheck(check, (_variants(check, cwe, cwe_name, (severity, when, detail), **more),), live)


_UNTRUSTED = "Deserialization of Untrusted Data"
_CREDENTIALS = "Use of Hard-coded Credentials"


def _pickle() -> TextCheck:
    rows = [(r"pickle\.loads?\s*\(", "CRITICAL"), (r"pickle\.Unpickler\s*\(", "CRITICAL"), (r"cloudpickle\.loads?\s*\(", "CRITICAL"), (r"dill\.loads?\s*\(", "CRITICAL"), (r"joblib\.load\s*\(", "HIGH"), (r"shelve\.open\s*\(", "HIGH"), (r"marshal\.loads?\s*\(", "HIGH")]
    return TextCheck("check_pickle", (_variants("check_pickle", "CWE-502", _UNTRUSTED, *((s, Rx(p), "Loading this format runs code that its author chose.") for p, s in rows)),))


def _command() -> TextCheck:
    name = ("check_command_injection", "CWE-78", "OS Command Injection")
    calls = [(c, "CRITICAL") for c in _CMD_CRITICAL] + [(c, "HIGH") for c in _CMD_HIGH]
    return TextCheck(name[0], (_variants(*name, *((s, _call(c), f"{c} starts a process; check where its arguments come from.") for c, s in calls)), _variants(*name, ("HIGH", Rx(r"shell\s*=\s*True"), "The command line goes through a shell."))))


def _sql() -> TextCheck:
    free = ~Named("sql_safe")
    rows = [(r"execute\s*\(\s*f[\"']", "An f-string is executed as SQL."), (r"exec_driver_sql\s*\(\s*f[\"']", "An f-string goes to the driver as SQL."), (r"\.execute\s*\([^)]*\+", "SQL is put together with +.")]
    return TextCheck("check_sql_injection", (_variants("check_sql_injection", "CWE-89", "SQL Injection", *(("CRITICAL", Rx(p) & free, d) for p, d in rows)),))


def _traversal() -> TextCheck:
    name = ("check_path_traversal", "CWE-22", "Path Traversal")
    return TextCheck(name[0], (_variants(*name, ("HIGH", Rx(r"lstrip\(['\"]/['\"]\)"), "Stripping slashes leaves ../ in place.")), _variants(*name, ("MEDIUM", Rx("relative_path") & Rx(r"open\s*\("), "A relative path is opened; resolve it and check its root."))))


def _secrets() -> TextCheck:
    rows = [("CRITICAL", r"(?:private_key|ssh_key|pem)\s*[:=]\s*[\"'][^\"']+[\"']", "A private key in the source."), ("CRITICAL", r"connection_url\s*=\s*[\"'][^\"']*://[^\"']+:[^\"']+@", "A connection URL with its password."), ("HIGH", r"(?:password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']", "A password in the source.")]
    return TextCheck("check_hardcoded_secrets", (_variants("check_hardcoded_secrets", "CWE-798", _CREDENTIALS, *((s, Rx(p, True) & ~_placeholder(), d) for s, p, d in rows)),))


def _tokens() -> TextCheck:
    rows = [(r"(?:api_key|apikey)\s*[:=]\s*[\"'][A-Za-z0-9_\-=]{16,}[\"']", "An API key in the source."), (r"(?:token|jwt)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+[\"']", "A signed web token in the source."), (r"(?:bearer|auth_token)\s*[:=]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']", "A bearer token in the source."), (r"(?:secret|client_secret)\s*[:=]\s*[\"'][A-Za-z0-9_\-+/=]{16,}[\"']", "A client secret in the source.")]
    return TextCheck("check_hardcoded_tokens", (_variants("check_hardcoded_tokens", "CWE-798", _CREDENTIALS, *(("CRITICAL", Rx(p, True, "trim") & ~_placeholder(), d) for p, d in rows)),))


def _crypto() -> TextCheck:
    rows = [(r"Crypto\.Cipher\.DES\b|pycryptodome.*DES\b", "DES keys can be searched."), (r"ARC4\b|RC4\b", "RC4 output is biased."), (r"MODE_ECB\b", "ECB shows the structure of the plain text."), (r"PKCS1_v1_5\b", "This padding leaks through error answers."), (r"hashlib\.md5\b.*\b(?:sign|hmac|sig|token|password|hash\b)", "MD5 guards something that matters.")]
    return TextCheck("check_weak_crypto", (_variants("check_weak_crypto", "CWE-327", "Use of a Broken or Risky Cryptographic Algorithm", *(("HIGH", Rx(p, True, "trim"), d) for p, d in rows)),))


def _tls() -> TextCheck:
    rows = [(r"verify\s*=\s*False", "Certificates are not checked."), (r"check_hostname\s*=\s*False", "Host names are not checked."), ("CERT_NONE", "The peer needs no certificate."), ("_create_unverified_context", "The context checks nothing.")]
    return TextCheck("check_tls_verify", (_variants("check_tls_verify", "CWE-295", "Improper Certificate Validation", *(("CRITICAL", Rx(p, on="trim"), d) for p, d in rows)),))


def _ssh() -> TextCheck:
    rows = [("AutoAddPolicy", "Unknown hosts are trusted."), ("WarningPolicy", "Unknown hosts only cause a warning."), (r"sshtunnel\.open_tunnel", "Set the host key of the tunnel.")]
    return TextCheck("check_ssh_host_key", (_variants("check_ssh_host_key", "CWE-322", "Key Exchange without Entity Authentication", *(("HIGH", Rx(p, on="trim"), d) for p, d in rows)),))


def _hash() -> TextCheck:
    name = ("check_weak_hash", "CWE-328", "Weak Cryptographic Hash")
    return TextCheck(name[0], (_variants(*name, ("MEDIUM", Rx(r"hashlib\.(?:md5|sha1)\s*\("), "Collisions for this hash are known.")), _variants(*name, ("MEDIUM", Rx(r"hashlib\.new\s*\(\s*[\"'](?:md5|md4|md2|sha1)[\"']", True), "Collisions for the hash named here are known."))))


def _pth() -> TextCheck:
    check, cwe = "check_pth_startup_hooks", "CWE-829"
    code = ~Named("is_pth")
    return TextCheck(check, ((Variant(check, cwe, ".pth Directory Added to sys.path", "HIGH", "Its .pth files run at start-up.", Rx(r"site\.addsitedir\s*\(", on="trim") & code),), (Variant(check, cwe, "Dynamic .pth Execution", "CRITICAL", "Code is run on the way to a .pth file.", Rx(r"exec\s*\(\s*(?:compile|open|base64)", on="trim") & Rx(r"\.pth") & code),)))


#: The first line of a .pth file that is code: found for each file, not for each line.
PTH_FILE = Variant("check_pth_startup_hooks", "CWE-829", "Inclusion of Functionality from Untrusted Control Sphere", "CRITICAL", "Every interpreter start runs this line.")


def _models() -> TextCheck:
    check, cwe = "check_model_file_load", "CWE-502"
    torch = Rx(r"torch\.load\s*\(", on="trim") & Rx(r"\.(?:pt|pth|ckpt)[\"']", on="trim")
    family = Rx(r"(?:joblib|pickle|cloudpickle|dill)\.load\s*\(", on="trim") & Rx(r".(?:pt|pkl|h5|joblib|ckpt)[\"']", on="trim")
    name = f"{_UNTRUSTED} (ML Model)"
    return TextCheck(check, ((Variant(check, cwe, name, "LOW", "A model file is loaded with weights_only; a format without code is safer still.", torch & Has("weights_only", "trim")), Variant(check, cwe, name, "CRITICAL", "A model file is loaded with the code in it.", torch)), (Variant(check, cwe, name, "HIGH", "A model file is unpickled.", family),), (Variant(check, cwe, f"{_UNTRUSTED} (Keras Model)", "HIGH", "Custom layers of the model can hold code.", Rx(r"(?:tf|keras)\.(?:models\.)?load_model\s*\(", on="trim")),)))


TEXT_CHECKS: tuple[TextCheck, ...] = (
    _pickle(),
    _command(),
    _sql(),
    _traversal(),
    _secrets(),
    _one("check_yaml_deserialize", "CWE-502", _UNTRUSTED, "CRITICAL", (Rx(r"yaml\.load\s*\(") & ~Has("SafeLoader")) | Rx(r"yaml\.unsafe_load\s*\("), "This loader builds any object that the document names."),
    _one("check_xxe", "CWE-611", "XXE (XML External Entity)", "HIGH", Rx(r"(?:xml\.etree|xml\.dom|xml\.sax)\.") | Named("lxml_line"), "The parser follows external entities."),
    _one("check_ssrf", "CWE-918", "Server-Side Request Forgery", "HIGH", (Rx(r"(?:requests|httpx)\.(?:get|post|put|patch|delete|head|options|request)\s*\(|urllib\.request\.urlopen\s*\(|aiohttp\.ClientSession") & ~Named("ssrf_safe")) | (Named("session_line") & ~Named("session_safe")), "Check who chooses the address of this request."),
    _one("check_tempfile", "CWE-377", "Insecure Temporary File", "HIGH", Has("tempfile.mktemp"), "Another process can take the name first."),
    _one("check_symlink", "CWE-61", "UNIX Symbolic Link Following", "MEDIUM", Has(".symlink_to") | Has("os.symlink"), "Check that the link's target stays inside."),
    _one("check_redos", "CWE-1333", "ReDoS", "MEDIUM", Rx(r"re\.(?:compile|match|search)") & Rx(r"\([^)]+[+*?]\)[+*?{]"), "A repeat within a repeat can take exponential time.", confidence="LOW"),
    _one("check_assert_security", "CWE-617", "Reachable Assertion", "MEDIUM", Rx(r"\Aassert ", on="trim") & ~Has("isinstance", "trim") & Rx(r"\b(is|==|!=|in)\b", on="trim") & Rx("(?:admin|owner|role|permission|authorized|authenticated)", True, "trim"), "Assertions vanish with -O; raise instead.", live=False),
    _one("check_exec_driver_sql", "CWE-89", "SQL Injection via exec_driver_sql", "CRITICAL", Rx(r"exec_driver_sql\s*\(\s*f[\"']") & ~Named("driver_safe"), "The driver gets an f-string as it is."),
    _one("check_supply_chain", "CWE-1104", "Supply Chain — Dependency Confusion", "HIGH", Has("--extra-index-url"), "Either index can serve either package."),
    _one("check_debug_mode", "CWE-489", "Active Debug Code", "MEDIUM", Rx(r"debug\s*=\s*True") & ~Has("docstring", "lower"), "Debugging is on.", confidence="LOW"),
    _one("check_timing_attack", "CWE-208", "Timing Attack", "LOW", Rx(r"==\s*['\"]") & Rx("(?:token|secret|password|auth)", True), "The comparison's time tells how much was right.", confidence="LOW"),
    _one("check_sensitive_exposure", "CWE-200", "Information Exposure", "MEDIUM", Has("traceback.print_exc") | Has("traceback.print_exception"), "Stack traces show internals."),
    _one("check_null_byte", "CWE-158", "NUL Byte Injection", "INFO", Rx(r"\\x00|\\0"), "A null byte ends strings in other languages."),
    _one("check_resource_limits", "CWE-770", "Unbounded Resource Allocation", "INFO", Rx(r"\.read\(\)") & ~Rx(r"read\(\d") & ~Rx("(?:chunk|iter_content|stream)", True), "The whole input is read at once."),
    _one("check_ssti", "CWE-1336", "Server-Side Template Injection", "HIGH", Rx(r"(?:Jinja2?\.Template|Template)\s*\("), "A template made from input runs as code."),
    _one("check_crlf", "CWE-93", "CRLF Injection", "HIGH", Rx(r"\\r\\n|%0d%0a|%0D%0A"), "Line ends in values can start new headers."),
    _one("check_ldap", "CWE-90", "LDAP Injection", "HIGH", Has("ldap.initialize") | Has("ldap3"), "Escape what goes into filters."),
    _hash(),
    _one("check_open_redirect", "CWE-601", "Open Redirect", "MEDIUM", Rx(r"(?:redirect|Redirect)\s*\("), "Check the target against a list."),
    _one("check_log_injection", "CWE-117", "Log Injection / Forging", "LOW", Rx(rf"\.(?:{_LOG})\s*\(\s*f[\"']") & ~Rx(r"%[srd]|\{!r\}|\{!s\}"), "Line ends in values can forge entries."),
    _one("check_arbitrary_write", "CWE-73", "External Control of File Name", "MEDIUM", Rx(r"(?:shutil\.copy|shutil\.move|os\.rename)\s*\("), "Check the target path."),
    _one("check_log_secrets", "CWE-532", "Insertion of Sensitive Information into Logs", "HIGH", Rx(rf"\.(?:{_LOG})\s*\(", on="trim") & Rx("(password|passwd|secret|token|api_key|apikey|auth_token|access_key|private_key)", True, "trim"), "A name in this call says that it is a secret."),
    _tls(),
    _one("check_zipslip", "CWE-22", "Path Traversal — ZipSlip / TarSlip", "HIGH", Rx(r"\.extractall\s*\(", on="trim") & ~Rx("(resolve|is_relative_to|member.*safe)", on="trim"), "Members named ../ land outside."),
    _tokens(),
    _crypto(),
    _one("check_trojan_source", "CWE-1007", "Trojan Source (Bidirectional Override)", "CRITICAL", Rx("[‪‫‬‭‮⁦⁧⁨⁩]"), "The line reads otherwise than it runs.", live=False),
    _ssh(),
    _one("check_pandas_pickle", "CWE-502", f"{_UNTRUSTED} (read_pickle)", "CRITICAL", Rx(r"(?:pd|pandas)\.read_pickle\s*\("), "The frame is unpickled."),
    _one("check_numpy_load_lib", "CWE-114", "Process Control (numpy library loading)", "HIGH", Rx(r"numpy\.(?:load|ctypeslib)\.", on="trim") & Rx(r"\.(so|dll|dylib)", on="trim"), "A shared library is loaded."),
    _one("check_pandas_xml_xxe", "CWE-611", "XXE via pandas.read_xml", "HIGH", Rx(r"(?:pd|pandas)\.read_xml\s*\(", on="trim") & ~Has("parser", "trim"), "The default parser follows external entities."),
    _pth(),
    _models(),
    _one("check_legacy_pycrypto", "CWE-1104", "Supply Chain — Unmaintained Dependency", "MEDIUM", Rx(r"\A(?:from|import)\s+Crypto\b", on="trim"), "The package has had no fixes for years."),
    _one("check_weak_tls_version", "CWE-326", "Inadequate Encryption Strength", "HIGH", Rx(r"PROTOCOL_(?:SSLv2|SSLv3|TLSv1)\b", on="trim"), "asks for a broken version of the protocol."),
    _one("check_bind_all_interfaces", "CWE-1327", "Binding to an Unrestricted IP Address", "MEDIUM", Rx(r"[\"']0\.0\.0\.0[\"']", on="trim"), "Every interface listens."),
    _one("check_parquet_arrow_deserialize", "CWE-502", f"{_UNTRUSTED} (Parquet+cloudpickle)", "CRITICAL", Rx(r"cloudpickle\.loads?\s*\(", on="trim") & Rx("(?:py)?arrow|parquet|arrow_ext|deserialize", on="lower"), "Metadata of a data file is unpickled.", confidence="HIGH"),
)

WEAK_TLS = r"PROTOCOL_(?:SSLv2|SSLv3|TLSv1)\b"
DECODE = r"(?:base64\.(?:b64decode|urlsafe_b64decode|decodestring)|zlib\.decompress|bz2\.decompress|codecs\.decode)\s*\("
EXECUTE = r"(?:exec|eval)\s*\("
CHAIN_LINES = 5
CHAIN = Variant("check_decode_exec_chains", "CWE-94", "Code Injection (decode-then-execute)", "CRITICAL", "What was just decoded is run.", confidence="HIGH")
