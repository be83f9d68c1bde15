"""The detection rule catalog.

Patterns are written in Python ``re`` syntax, the form users write custom rules in;
``auditlake.functions.dialect`` turns them into JVM regular expressions.

``gate`` / ``need`` are ours: lower-case literals of which any one (``gate``) and every one
(``need``) must occur in the lower-cased text for the pattern to be able to match. They let the
scan skip nearly all regular expressions on nearly all files. ``near`` is a cheap pattern over the
lower-cased text that any match also satisfies, for rules whose literals are common in prose.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from auditlake.catalog.taxonomy import SEVERITY_RANK, weakness
from auditlake.functions.onepass import one_pass

JS = (".js", ".ts", ".jsx", ".tsx", ".vue", ".svelte", ".html", ".htm")
PY = (".py",)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    description: str
    gate: tuple[str, ...] = ()
    need: tuple[str, ...] = ()
    near: str = ""
    extensions: tuple[str, ...] | None = None
    confidence: str = "HIGH"
    cwe: int | None = None
    fix_hint: str = ""
    # filled in from the family
    family: str = ""
    check: str = ""
    category: str = ""
    severity: str = ""
    remediation: str = ""
    check_ord: int = 0
    rule_ord: int = 0
    in_history: bool = False
    # whether the pattern is ours to rewrite; users' patterns are matched as they are
    linear: bool = True

    @property
    def scanned(self) -> tuple[str, bool]:
        """The pattern as it is matched, and whether that is a form with groups (``one_pass``)."""
        form = one_pass(self.pattern) if self.linear else None
        return (form, True) if form else (self.pattern, False)

    @property
    def severity_rank(self) -> int:
        return SEVERITY_RANK[self.severity]

    @property
    def weakness(self) -> tuple[str, str, str]:
        return weakness(self.cwe)


@dataclass(frozen=True)
class Family:
    name: str
    check: str
    category: str
    severity: str
    remediation: str
    rules: tuple[Rule, ...]


# --- fix hints (our wording) ----------------------------------------------------------------

_HINT_BIND = "cur.execute('SELECT name FROM users WHERE id = %s', [user_id])"
_HINT_ARGV = "subprocess.run(['tool', argument], check=True)  # argument list, shell left off"
_HINT_TEXT = "node.textContent = value  # inserted as text, never parsed as markup"
_HINT_PATH = "path = (base / name).resolve()\nif not path.is_relative_to(base): raise ValueError(name)"
_HINT_HASH_PY = "from argon2 import PasswordHasher\ndigest = PasswordHasher().hash(password)"
_HINT_HASH_JS = "const argon2 = require('argon2')\nconst digest = await argon2.hash(password)"
_HINT_COOKIE = "# keep the session token in a Secure, HttpOnly cookie set by the server"
_HINT_AEAD = "from cryptography.hazmat.primitives.ciphers.aead import AESGCM\nbox = AESGCM(key).encrypt(nonce, data, None)"
_HINT_RANDOM = "import secrets\nvalue = secrets.token_urlsafe(32)"


# Rule ids, patterns, file types, confidence and CWE number of every rule, in the
# order in which they are tried; descriptions are ours.
FAMILIES: tuple[Family, ...] = (
    Family("secrets", "secrets", "Secrets", "CRITICAL",
           "Load the value from the environment or a secret store, and rotate it", (
        Rule("SEC-001", r"""["'](?:sk|pk)[-_](?:live|test)[-_][a-zA-Z0-9]{24,}["']""",
             "Payment provider key in source", gate=("k_live", "k-live", "k_test", "k-test"), cwe=798),
        Rule("SEC-002", r"""["']AIza[a-zA-Z0-9_-]{35}["']""",
             "Google API key in source", gate=("aiza",), cwe=798),
        Rule("SEC-003", r"""["']AKIA[A-Z0-9]{16}["']""",
             "AWS access key id in source", gate=("akia",), cwe=798),
        Rule("SEC-004", r"""["']ghp_[a-zA-Z0-9]{36}["']""",
             "GitHub access token in source", gate=("ghp_",), cwe=798),
        Rule("SEC-005", r"""["']xox[baprs]-[a-zA-Z0-9-]{10,}["']""",
             "Slack token in source", gate=("xox",), cwe=798),
        Rule("SEC-006", r"""["']eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*["']""",
             "Signed JWT in source", gate=("eyj",), cwe=798),
        Rule("SEC-007", r"""["']your[-_]?256[-_]?bit[-_]?secret["']""",
             "Tutorial placeholder used as signing secret", gate=('"your', "'your"), need=("256",),
             confidence="MEDIUM", cwe=798),
        Rule("SEC-008", r"""["']secret["']""",
             "The word secret used as a value", gate=("secret",), near=r"""["']secret["']""", confidence="MEDIUM", cwe=798),
        Rule("SEC-009", r"""["']password123["']""",
             "Guessable password literal", gate=("password123",), confidence="MEDIUM", cwe=521),
        Rule("SEC-010", r"""["']admin@example\.com["']""",
             "Sample administrator account", gate=("admin@example.com",), confidence="MEDIUM", cwe=798),
        Rule("SEC-011", r"""["']changeme["']""",
             "Default password left in place", gate=("changeme",), confidence="MEDIUM", cwe=798),
        Rule("SEC-012", r"""["']?password["']?\s*[=:]\s*["'][^"']{1,}["']""",
             "Password assigned from a literal", gate=("password",), confidence="MEDIUM", cwe=798,
             fix_hint="password = os.environ['APP_PASSWORD']"),
        Rule("SEC-013", r"""["']?api[_-]?key["']?\s*[=:]\s*["'][a-zA-Z0-9]{16,}["']""",
             "API key assigned from a literal", gate=("api",), near=r"api[_-]?key",
             confidence="MEDIUM", cwe=798, fix_hint="api_key = os.environ['SERVICE_API_KEY']"),
        Rule("SEC-017", r"""["']?api[_-]?secret["']?\s*[=:]\s*["'][a-zA-Z0-9]{16,}["']""",
             "API secret assigned from a literal", gate=("api",), near=r"api[_-]?secret",
             confidence="MEDIUM", cwe=798, fix_hint="api_secret = os.environ['SERVICE_API_SECRET']"),
        Rule("SEC-018", r"""["'](?:PK|AK)[A-Z0-9]{20,}["']""",
             "Brokerage API key in source", near=r"""["'][pa]k[a-z0-9]{20}""", cwe=798),
        Rule("SEC-019", r"""["']sk-ant-[a-zA-Z0-9_-]{40,}["']""",
             "Model provider key (sk-ant form) in source", gate=("sk-ant-",), cwe=798),
        Rule("SEC-020", r"""["']sk-[a-zA-Z0-9]{48}["']""",
             "Model provider key (sk form) in source", gate=("sk-",), near=r"""["']sk-""", cwe=798),
        Rule("SEC-021", r"""^[A-Z_]*(?:KEY|SECRET|TOKEN|PASSWORD)[A-Z_]*=[A-Za-z0-9+/]{16,}$""",
             "Bare secret in an environment or config file", gate=("key", "secret", "token", "password"),
             need=("=",), cwe=798),
        Rule("SEC-014", r"""mongodb(?:\+srv)?://[^"'\s]+:[^"'\s]+@""",
             "MongoDB URL carrying credentials", gate=("mongodb",), need=("://", "@"), cwe=798),
        Rule("SEC-015", r"""postgres(?:ql)?://[^"'\s]+:[^"'\s]+@""",
             "PostgreSQL URL carrying credentials", gate=("postgres",), need=("://", "@"), cwe=798),
        Rule("SEC-016", r"""mysql://[^"'\s]+:[^"'\s]+@""",
             "MySQL URL carrying credentials", gate=("mysql://",), need=("@",), cwe=798),
    )),
    Family("sql", "injection", "Injection (sql)", "CRITICAL",
           "Bind parameters instead of building the statement from text", (
        Rule("INJ-001", r"""execute\s*\(\s*["'].*?\%s.*?["'].*?\%""",
             "Statement built with percent formatting", gate=("execute",), need=("%s",), cwe=89, fix_hint=_HINT_BIND),
        Rule("INJ-002", r"""execute\s*\(\s*f["']""",
             "Statement built with an f-string", gate=("execute",), extensions=PY, cwe=89, fix_hint=_HINT_BIND),
        Rule("INJ-003", r"""execute\s*\(\s*["'].*?\+""",
             "Statement literal joined with plus", gate=("execute",), need=("+",), confidence="MEDIUM", cwe=89,
             fix_hint=_HINT_BIND),
        Rule("INJ-004", r"""cursor\.execute\s*\([^,)]*\+""",
             "Cursor call with a joined statement", gate=("cursor.execute",), need=("+",), confidence="MEDIUM",
             cwe=89, fix_hint=_HINT_BIND),
        Rule("INJ-005", r"""\.query\s*\(\s*[`"'].*?\$\{""",
             "Query built with a template literal", gate=(".query",), need=("${",), cwe=89),
        Rule("INJ-006", r"""SELECT.*FROM.*WHERE.*\+.*\+""",
             "Raw select joined from pieces", gate=("select",), need=("from", "where", "+"),
             confidence="MEDIUM", cwe=89),
    )),
    Family("command", "injection", "Injection (command)", "CRITICAL",
           "Pass an argument list to a fixed program and never evaluate input", (
        Rule("INJ-010", r"""os\.system\s*\(""",
             "Command run through os.system", gate=("os.system",), extensions=PY, cwe=78, fix_hint=_HINT_ARGV),
        Rule("INJ-011", r"""subprocess\.[a-z]+\s*\([^)]*shell\s*=\s*True""",
             "Subprocess started through a shell", gate=("subprocess.",), need=("shell",), extensions=PY, cwe=78,
             fix_hint=_HINT_ARGV),
        Rule("INJ-012", r"""eval\s*\(\s*(?:request|req|input|user)""",
             "Input passed to eval", gate=("eval",), need=("(",), extensions=PY, cwe=94),
        Rule("INJ-013", r"""exec\s*\(\s*(?:request|req|input|user)""",
             "Input passed to exec", gate=("exec",), need=("(",), extensions=PY, cwe=94),
        Rule("INJ-014", r"""child_process\.exec\s*\(""",
             "Command run through child_process.exec", gate=("child_process.exec",), extensions=JS, cwe=78),
        Rule("INJ-015", r"""subprocess\.[a-z]+\s*\(\s*[^)\[]*\+""",
             "Subprocess command joined from pieces", gate=("subprocess.",), need=("+",), extensions=PY, cwe=78,
             fix_hint=_HINT_ARGV),
    )),
    Family("path_traversal", "injection", "Injection (path_traversal)", "HIGH",
           "Resolve the path and require it to stay inside the base directory", (
        Rule("INJ-040", r"""\.\.[\\/]""",
             "Parent directory step in a path", gate=("..",), near=r"\.\.[\\/]", confidence="LOW", cwe=22, fix_hint=_HINT_PATH),
        Rule("INJ-041", r"""os\.path\.join\s*\([^)]*(?:request\.|req\.|input\(|user_)""",
             "Path joined with input", gate=("os.path.join",), extensions=PY, cwe=22, fix_hint=_HINT_PATH),
        Rule("INJ-042", r"""open\s*\(\s*(?:request\.|req\.|input\(|user_)""",
             "File opened by a name taken from input", gate=("open",), need=("(",), extensions=PY, cwe=22,
             fix_hint=_HINT_PATH),
    )),
    Family("xss", "xss", "Injection (xss)", "HIGH",
           "Insert values as text, or sanitise markup first", (
        Rule("INJ-020", r"""innerHTML\s*=\s*(?!['"]\s*['"])""",
             "Assignment to innerHTML", gate=("innerhtml",), extensions=JS, cwe=79, fix_hint=_HINT_TEXT),
        Rule("INJ-021", r"""document\.write\s*\(""",
             "Call of document.write", gate=("document.write",), extensions=JS, cwe=79, fix_hint=_HINT_TEXT),
        Rule("INJ-022", r"""\.html\s*\(\s*(?:req|request|user|data)""",
             "Input passed to .html()", gate=(".html",), need=("(",), extensions=JS, cwe=79),
        Rule("INJ-023", r"""dangerouslySetInnerHTML""",
             "Use of dangerouslySetInnerHTML", gate=("dangerouslysetinnerhtml",), extensions=JS, cwe=79),
        Rule("INJ-024", r"""v-html\s*=""",
             "Use of the v-html directive", gate=("v-html",), extensions=JS, cwe=79),
        Rule("INJ-025", r"""\{\{\{.*\}\}\}""",
             "Unescaped template output", gate=("{{{",), need=("}}}",), extensions=JS, cwe=79),
    )),
    Family("nosql", "injection", "Injection (nosql)", "HIGH",
           "Check the shape and types of query documents built from input", (
        Rule("INJ-030", r"""\.find\s*\(\s*(?:req\.body|request\.body)""",
             "Request body used as a find filter", gate=(".find",), need=(".body",), extensions=JS, cwe=943),
        Rule("INJ-031", r"""\.findOne\s*\(\s*(?:req\.body|request\.body)""",
             "Request body used as a findOne filter", gate=(".findone",), need=(".body",), extensions=JS, cwe=943),
        Rule("INJ-032", r"""\$where.*(?:req|request|user)""",
             "Input inside a $where clause", gate=("$where",), extensions=JS, cwe=943),
    )),
    Family("auth", "auth", "Authentication", "HIGH",
           "Use a password hash made for the purpose and keep tokens out of script reach", (
        Rule("AUTH-001", r"""hashlib\.md5\s*\(""",
             "MD5 used where a password hash belongs", gate=("hashlib.md5",), extensions=PY, cwe=916,
             fix_hint=_HINT_HASH_PY),
        Rule("AUTH-002", r"""hashlib\.sha1\s*\(""",
             "SHA-1 used where a password hash belongs", gate=("hashlib.sha1",), extensions=PY, cwe=916,
             fix_hint=_HINT_HASH_PY),
        Rule("AUTH-003", r"""crypto\.createHash\s*\(\s*["']md5""",
             "MD5 digest created in Node", gate=("crypto.createhash",), need=("md5",), extensions=JS, cwe=916,
             fix_hint=_HINT_HASH_JS),
        Rule("AUTH-004", r"""crypto\.createHash\s*\(\s*["']sha1""",
             "SHA-1 digest created in Node", gate=("crypto.createhash",), need=("sha1",), extensions=JS, cwe=916,
             fix_hint=_HINT_HASH_JS),
        Rule("AUTH-010", r"""localStorage\.setItem\s*\(\s*["'](?:token|jwt|auth)""",
             "Token kept in localStorage", gate=("localstorage.setitem",), extensions=JS, cwe=922,
             fix_hint=_HINT_COOKIE),
        Rule("AUTH-011", r"""sessionStorage\.setItem\s*\(\s*["'](?:token|jwt|auth)""",
             "Token kept in sessionStorage", gate=("sessionstorage.setitem",), extensions=JS, cwe=922,
             fix_hint=_HINT_COOKIE),
        Rule("AUTH-020", r"""@app\.route\s*\([^)]*\)\s*\ndef\s+\w+\s*\([^)]*\):""",
             "Route handler with no decorator between route and function", gate=("@app.route",), need=("def",),
             extensions=PY, confidence="LOW", cwe=306),
        Rule("AUTH-021", r"""router\.(get|post|put|delete|patch)\s*\([^)]*,\s*(?:async\s+)?\([^)]*\)\s*=>""",
             "Route handler with no middleware in view", gate=("router.",), need=("=>",), extensions=JS,
             confidence="LOW", cwe=306),
    )),
    Family("crypto", "crypto", "Cryptography", "HIGH",
           "Use an authenticated modern cipher and a cryptographic random source", (
        Rule("CRYPTO-001", r"""\bDES\s*\(""",
             "DES cipher", gate=("des",), need=("(",), near=r"des\s*\(", cwe=327, fix_hint=_HINT_AEAD),
        Rule("CRYPTO-002", r"""\bBlowfish\s*\(""",
             "Blowfish cipher", gate=("blowfish",), cwe=327, fix_hint=_HINT_AEAD),
        Rule("CRYPTO-003", r"""\bRC4\s*\(""",
             "RC4 cipher", gate=("rc4",), cwe=327, fix_hint=_HINT_AEAD),
        Rule("CRYPTO-010", r"""random\.randint\s*\(.*(?:token|key|secret|password)""",
             "random.randint feeding a secret", gate=("random.randint",), extensions=PY, cwe=338,
             fix_hint=_HINT_RANDOM),
        Rule("CRYPTO-011", r"""Math\.random\s*\(\).*(?:token|key|secret|id)""",
             "Math.random feeding a secret", gate=("math.random",), extensions=JS, cwe=338,
             fix_hint="const value = crypto.getRandomValues(new Uint8Array(32))"),
        Rule("CRYPTO-012", r"""random\.choice\s*\(.*(?:token|key|secret)""",
             "random.choice feeding a secret", gate=("random.choice",), extensions=PY, cwe=338,
             fix_hint=_HINT_RANDOM),
    )),
    Family("cloud", "cloud", "Cloud/Infrastructure", "HIGH",
           "Grant the least access the service needs", (
        Rule("CLOUD-001", r"""\.ref\s*\(\s*["']["'\s]*\)\.set""",
             "Write to the database root", gate=(".ref",), need=(".set",), cwe=863),
        Rule("CLOUD-002", r"""supabase\s*=\s*createClient\s*\([^)]*anon[^)]*\)""",
             "Anonymous client key in use; row policies must hold", gate=("supabase",), need=("anon",), cwe=732),
        Rule("CLOUD-003", r"""service[_-]?role[_-]?key""",
             "Service role key mentioned", gate=("service",), near=r"service[_-]?role", cwe=798),
        Rule("CLOUD-010", r"""cors\s*\(\s*\{\s*origin\s*:\s*["']?\*["']?""",
             "CORS open to every origin", gate=("cors",), need=("*",), cwe=346),
        Rule("CLOUD-011", r"""Access-Control-Allow-Origin.*\*""",
             "Allow-Origin header set to a star", gate=("access-control-allow-origin",), need=("*",), cwe=346),
        Rule("CLOUD-012", r"""res\.setHeader\s*\(\s*['"]Access-Control-Allow-Origin['"]\s*,\s*['"]\\*['"]""",
             "Allow-Origin header set to an empty value", gate=("access-control-allow-origin",),
             need=("res.setheader",), cwe=346),
        Rule("CLOUD-020", r"""ACL\s*[=:]\s*["']public-read""",
             "Bucket readable by anyone", gate=("public-read",), cwe=732),
        Rule("CLOUD-021", r"""BlockPublicAccess.*false""",
             "Public access block switched off", gate=("blockpublicaccess",), cwe=732),
    )),
    Family("data", "data", "Data Handling", "HIGH",
           "Parse untrusted data with a loader that cannot run code, and validate it", (
        Rule("DATA-001", r"""pickle\.loads?\s*\(""",
             "Unpickling of data", gate=("pickle.load",), extensions=PY, cwe=502,
             fix_hint="import json\nrecord = json.loads(payload)"),
        # DATA-002 and DATA-003 have no guard against safe loaders: it could never fail.
        Rule("DATA-002", r"""yaml\.load\s*\([^)]*""",
             "yaml.load call", gate=("yaml.load",), extensions=(".py", ".yaml", ".yml"), cwe=502,
             fix_hint="import yaml\nrecord = yaml.safe_load(stream)"),
        Rule("DATA-003", r"""torch\.load\s*\([^)]*""",
             "torch.load call", gate=("torch.load",), extensions=PY, cwe=502,
             fix_hint="state = torch.load(file, weights_only=True)"),
        Rule("DATA-010", r"""json\.loads?\s*\(.*request""",
             "Request parsed without a schema", gate=("json.load",), need=("request",), cwe=20),
    )),
    Family("debug", "debug", "Debug", "MEDIUM",
           "Switch debug output off in deployed configurations", (
        Rule("DBG-001", r"""app\.run\s*\([^)]*debug\s*=\s*True""",
             "Development server started in debug mode", gate=("app.run",), need=("debug",), extensions=PY, cwe=215),
        Rule("DBG-002", r"""(?<!\w)DEBUG\s*=\s*True""",
             "DEBUG flag set to True", gate=("debug",), need=("true",), extensions=PY, cwe=215),
        Rule("DBG-003", r"""["']debug["']\s*:\s*true""",
             "Debug switched on in configuration", gate=("debug",), near=r"""["']debug["']""", confidence="LOW", cwe=215),
        Rule("DBG-004", r"""console\.log\s*\([^)]*(?:password|token|secret|key|auth|credential)""",
             "Sensitive value logged to the console", gate=("console.log",), extensions=JS, cwe=215),
        Rule("DBG-005", r"""print\s*\([^)]*(?:password|token|secret|api_key|credential)""",
             "Sensitive value printed", gate=("print",), need=("(",), extensions=PY, cwe=215),
    )),
    Family("https", "https", "Network", "MEDIUM",
           "Use HTTPS, and mark cookies Secure and HttpOnly", (
        Rule("NET-001", r"""["']http://(?!localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|example\.com)[a-zA-Z0-9][^"']{4,}["']""",
             "Plain HTTP address in a literal", gate=("http://",), near=r"""["']http://""", confidence="MEDIUM", cwe=319),
        Rule("NET-002", r"""httpOnly\s*[=:]\s*false""",
             "Cookie readable by scripts", gate=("httponly",), need=("false",), cwe=614),
        Rule("NET-003", r"""sameSite\s*[=:]\s*["']?none["']?(?!.*[Ss]ecure)""",
             "SameSite none without Secure", gate=("samesite",), need=("none",), cwe=614),
        Rule("NET-004", r"""(?:SESSION_COOKIE_SECURE|CSRF_COOKIE_SECURE|SESSION_COOKIE_HTTPONLY)\s*=\s*False""",
             "Cookie protection switched off in settings", gate=("cookie_secure", "cookie_httponly"),
             need=("false",), cwe=614),
    )),
    Family("ssrf", "ssrf", "SSRF", "HIGH",
           "Check the target against a list of allowed hosts before the request", (
        Rule("SSRF-001", r"""requests\.(get|post|put|delete|patch|head)\s*\([^)]*(?:request\.|req\.|\.args|\.form|\.data|user_|input\()""",
             "Outgoing request to an address from input (requests)", gate=("requests.",), extensions=PY,
             confidence="MEDIUM", cwe=918),
        Rule("SSRF-002", r"""urllib\.request\.urlopen\s*\([^)]*(?:request\.|req\.|\.args|\.form|user_|input\()""",
             "Outgoing request to an address from input (urllib)", gate=("urllib.request.urlopen",), extensions=PY,
             confidence="MEDIUM", cwe=918),
        Rule("SSRF-003", r"""fetch\s*\(\s*(?:req\b|request\b|user|params|searchParams|formData)""",
             "Outgoing request to an address from input (fetch)", gate=("fetch",), need=("(",), extensions=JS,
             confidence="MEDIUM", cwe=918),
        Rule("SSRF-004", r"""axios\.(get|post|put|delete|patch)\s*\(\s*(?:req\b|request\b|user|params)""",
             "Outgoing request to an address from input (axios)", gate=("axios.",), extensions=JS,
             confidence="MEDIUM", cwe=918),
        Rule("SSRF-005", r"""http(?:s)?\.(?:get|request)\s*\(\s*(?:req\b|request\b|user|params)""",
             "Outgoing request to an address from input (http module)",
             gate=("http",), near=r"https?\.(?:get|request)", extensions=JS,
             confidence="MEDIUM", cwe=918),
    )),
    Family("jwt", "jwt", "JWT", "CRITICAL",
           "Verify signature and expiry with one fixed algorithm", (
        Rule("JWT-001", r"""algorithms?\s*[=:]\s*["']none["']""",
             "Token algorithm none", gate=("algorithm",), need=("none",),
             extensions=(".py", ".js", ".ts", ".jsx", ".tsx"), cwe=347),
        Rule("JWT-002", r"""(?:verify\s*=\s*False|options\s*=\s*\{[^}]*["']verify["']\s*:\s*False)""",
             "Token signature not verified", gate=("verify",), need=("false",), extensions=PY, cwe=347),
        Rule("JWT-003", r"""jwt\.decode\s*\([^)]*,\s*["'][^"']+["'][^)]*\)""",
             "Token decoded with a literal key or algorithm", gate=("jwt.decode",), cwe=347),
        Rule("JWT-004", r"""(?:HS|RS|ES)(?:256|384|512).*(?:HS|RS|ES)(?:256|384|512)""",
             "Several token algorithms accepted", gate=("s256", "s384", "s512"), confidence="LOW", cwe=347),
        Rule("JWT-005", r"""ignore_expiration\s*=\s*True""",
             "Token expiry ignored", gate=("ignore_expiration",), extensions=PY, confidence="LOW", cwe=347),
    )),
    Family("headers", "headers", "Security Headers", "MEDIUM",
           "Send strict CSP, HSTS and framing headers", (
        Rule("HDR-001", r"""X-Frame-Options.{0,30}[=:,]\s*["']?ALLOW(?!ED)""",
             "Framing allowed by header", gate=("x-frame-options",), need=("allow",), confidence="MEDIUM", cwe=693),
        Rule("HDR-002", r"""Access-Control-Allow-Credentials["']?\s*[=:]\s*["']?true""",
             "Credentials allowed across origins", gate=("access-control-allow-credentials",), confidence="MEDIUM",
             cwe=693),
        Rule("HDR-003", r"""hsts\s*:\s*false""",
             "HSTS switched off in middleware", gate=("hsts",), need=("false",), extensions=JS, confidence="LOW",
             cwe=693),
        Rule("HDR-004", r"""SECURE_HSTS_SECONDS\s*=\s*0""",
             "HSTS lifetime of zero", gate=("secure_hsts_seconds",), extensions=PY, confidence="LOW", cwe=693),
        Rule("HDR-005", r"""SECURE_SSL_REDIRECT\s*=\s*False""",
             "HTTPS redirect switched off", gate=("secure_ssl_redirect",), extensions=PY, confidence="LOW", cwe=693),
        Rule("HDR-006", r"""Content-Security-Policy["']?\s*[=:]\s*["']?\*""",
             "Content policy set to a star", gate=("content-security-policy",), need=("*",), confidence="LOW",
             cwe=693),
    )),
)

# The checks a user may select, in the order they run. ``injection`` covers every
# injection family; ``xss`` alone selects only that one.
CHECKS = ("secrets", "injection", "xss", "auth", "crypto", "cloud", "data", "debug", "https", "ssrf", "jwt", "headers")

# Secret rules left out of commit history audits.
NOT_IN_HISTORY = ("SEC-008", "SEC-009", "SEC-010", "SEC-011")

# Entropy rule. Names that sound secret, assigned a quoted run of 20+ key characters.
ENTROPY_RULE_ID = "SEC-ENT"
ENTROPY_BITS = 4.5
ENTROPY_PATTERN = (
    r"""(?:api[_-]?key|api[_-]?secret|secret[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?token|bearer|"""
    r"""client[_-]?secret|app[_-]?secret|signing[_-]?key|encryption[_-]?key|webhook[_-]?secret|"""
    r"""jwt[_-]?secret|hmac[_-]?key)\s*[=:]\s*["']([A-Za-z0-9+/=_\-]{20,})["']"""
)
ENTROPY_GATE = ("key", "secret", "token", "bearer")
ENTROPY_NEAR = r"""(?:key|secret|token|bearer)\s*[=:]\s*["']"""

# Fixed value: quoted runs replaced when a secret is shown.
MASK_PATTERN = r"""(["'])([A-Za-z0-9+/=_\-\.@]{8,})\1"""

UNTRACKED_ENV_RULE_ID = "GIT-001"


def _number(families: Iterable[Family]) -> tuple[Rule, ...]:
    out = []
    for check_ord, fam in enumerate(families):
        for rule in fam.rules:
            out.append(replace(
                rule, family=fam.name, check=fam.check, category=fam.category, severity=fam.severity,
                remediation=fam.remediation, check_ord=check_ord, rule_ord=len(out),
                in_history=fam.name == "secrets" and rule.rule_id not in NOT_IN_HISTORY,
            ))
    return tuple(out)


RULES: tuple[Rule, ...] = _number(FAMILIES)
RULE_BY_ID = {r.rule_id: r for r in RULES}
SECRETS = FAMILIES[0]

# Rules that are not a plain pattern match; they share the finding layout.
ENTROPY_RULE = Rule(
    ENTROPY_RULE_ID, ENTROPY_PATTERN, "High-entropy secret string", gate=ENTROPY_GATE, near=ENTROPY_NEAR, confidence="MEDIUM", cwe=798,
    fix_hint=RULE_BY_ID["SEC-013"].fix_hint, family="secrets", check="secrets", category="Secrets",
    severity="CRITICAL", remediation=SECRETS.remediation, check_ord=len(FAMILIES), rule_ord=len(RULES),
    in_history=True,
)
UNTRACKED_ENV_RULE = Rule(
    UNTRACKED_ENV_RULE_ID, "", "Environment file not covered by the ignore file", cwe=312, family="secrets",
    check="secrets", category="Secrets", severity="CRITICAL",
    remediation="Add the environment file to the ignore file and rotate what it holds",
    check_ord=len(FAMILIES) + 1, rule_ord=len(RULES) + 1,
)


def select_rules(checks: Iterable[str] | None = None, exclude_rules: Iterable[str] = ()) -> tuple[Rule, ...]:
    """Rules of the chosen checks minus the excluded ids, decided while the plan is built.

    No checks at all (``None`` or empty) means every check.
    """
    chosen = set(checks or ())
    dropped = set(exclude_rules)

    def wanted(rule: Rule) -> bool:
        if not chosen or rule.check in chosen:
            return True
        return rule.check == "xss" and "injection" in chosen

    return tuple(r for r in RULES if wanted(r) and r.rule_id not in dropped)
