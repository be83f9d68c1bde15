"""Invented code lines that rules must and must not match; no value is a real credential."""

from __future__ import annotations

HEX40 = "0123456789abcdef" * 2 + "01234567"
ALNUM24 = "aB3dE5fG7hI9jK1lM2nO4pQ6"
ALNUM48 = ALNUM24 * 2
UPPER16 = "Q7W3E9R1T5Y2U8Z4"
RANDOM32 = "aB3dE5fG7hI9jK1lM2nO4pQ6rS8tU0vW"

# rule id -> one snippet that the rule finds exactly once
POSITIVE = {
    "SEC-001": f'charge = "sk_live_{ALNUM24}"',
    "SEC-002": f"maps = 'AIza{ALNUM24}_-{ALNUM24[:9]}'",
    "SEC-003": f'access = "AKIA{UPPER16}"',
    "SEC-004": f'hub = "ghp_{ALNUM24}{ALNUM24[:12]}"',
    "SEC-005": 'chat = "xoxb-12345678901-abcdef"',
    "SEC-006": 'session = "eyJhbGciOi.eyJzdWIiOi.c2lnbg"',
    "SEC-007": 'sign = "your-256-bit-secret"',
    "SEC-008": "cookie('secret')",
    "SEC-009": 'login("password123")',
    "SEC-010": 'mail = "admin@example.com"',
    "SEC-011": 'pin = "changeme"',
    "SEC-012": 'password: "hunter2"',
    "SEC-013": f'"api_key": "{ALNUM24}"',
    "SEC-017": f"api-secret = '{ALNUM24}'",
    "SEC-018": f'broker = "PK{UPPER16}ABCD"',
    "SEC-019": f'model = "sk-ant-{ALNUM48}"',
    "SEC-020": f'other = "sk-{ALNUM48}"',
    "SEC-021": f"STRIPE_KEY={ALNUM24}",
    "SEC-014": "mongodb+srv://app:pass@db.internal/x",
    "SEC-015": "postgresql://app:pass@db.internal/x",
    "SEC-016": "mysql://app:pass@db.internal/x",
    "INJ-001": 'db.execute("SELECT a FROM t WHERE id = %s" % key)',
    "INJ-002": "db.execute(f'DROP TABLE {name}')",
    "INJ-003": 'db.execute("DELETE FROM t WHERE id = " + key)',
    "INJ-004": "cursor.execute(head + tail)",
    "INJ-005": "pool.query(`INSERT INTO t VALUES (${v})`)",
    "INJ-006": "q = select a from t where b = ' + x + '",
    "INJ-010": "os.system('ls')",
    "INJ-011": "subprocess.run(cmd,\n    shell=True)",
    "INJ-012": "eval(request.form['q'])",
    "INJ-013": "exec( user_code )",
    "INJ-014": "child_process.exec(line)",
    "INJ-015": "subprocess.call(base + arg)",
    "INJ-040": "include ../conf/site",
    "INJ-041": "os.path.join(root, request.args['f'])",
    "INJ-042": "open(req.params)",
    "INJ-020": "box.innerHTML = value",
    "INJ-021": "document.write(value)",
    "INJ-022": "$('#a').html(data)",
    "INJ-023": "<div dangerouslySetInnerHTML={x} />",
    "INJ-024": '<p v-html="body"></p>',
    "INJ-025": "{{{ body }}}",
    "INJ-030": "users.find(req.body)",
    "INJ-031": "users.findOne( request.body )",
    "INJ-032": "f({ $where: 'this.a == ' + user })",
    "AUTH-001": "hashlib.md5(pw)",
    "AUTH-002": "hashlib.sha1 (pw)",
    "AUTH-003": "crypto.createHash('md5')",
    "AUTH-004": 'crypto.createHash("sha1")',
    "AUTH-010": "localStorage.setItem('token', t)",
    "AUTH-011": "sessionStorage.setItem('jwt', t)",
    "AUTH-020": "@app.route('/admin')\ndef admin():",
    "AUTH-021": "router.get('/admin', async (req, res) => {",
    "CRYPTO-001": "c = DES(k)",
    "CRYPTO-002": "c = Blowfish(k)",
    "CRYPTO-003": "c = RC4(k)",
    "CRYPTO-010": "v = random.randint(1, 9)  # reset token",
    "CRYPTO-011": "const v = Math.random() // session id",
    "CRYPTO-012": "v = random.choice(pool)  # secret",
    "CLOUD-001": "db.ref('').set(v)",
    "CLOUD-002": "const supabase = createClient(u, anonKey)",
    "CLOUD-003": "service-role-key",
    "CLOUD-010": "use(cors({ origin: '*' }))",
    "CLOUD-011": "Access-Control-Allow-Origin: *",
    "CLOUD-012": "res.setHeader('Access-Control-Allow-Origin', '')",
    "CLOUD-020": "ACL='public-read'",
    "CLOUD-021": "BlockPublicAccess: false",
    "DATA-001": "pickle.loads(b)",
    "DATA-002": "yaml.load(f)",
    "DATA-003": "torch.load(p)",
    "DATA-010": "json.loads(request.data)",
    "DBG-001": "app.run(port=1, debug=True)",
    "DBG-002": "DEBUG = True",
    "DBG-003": '"debug": true',
    "DBG-004": "console.log('auth', v)",
    "DBG-005": "print('token', v)",
    "NET-001": 'fetchAll("http://files.acme.org/a")',
    "NET-002": "httpOnly: false",
    "NET-003": "sameSite: 'none'",
    "NET-004": "SESSION_COOKIE_SECURE = False",
    "SSRF-001": "requests.get(request.args['u'])",
    "SSRF-002": "urllib.request.urlopen(user_url)",
    "SSRF-003": "fetch(params.u)",
    "SSRF-004": "axios.post(req.u)",
    "SSRF-005": "https.get(user.u)",
    "JWT-001": 'algorithms="none"',
    "JWT-002": "decode(t, verify=False)",
    "JWT-003": 'jwt.decode(t, "k")',
    "JWT-004": '["HS256", "RS512"]',
    "JWT-005": "ignore_expiration = True",
    "HDR-001": "X-Frame-Options: ALLOWALL",
    "HDR-002": "Access-Control-Allow-Credentials: true",
    "HDR-003": "hsts: false",
    "HDR-004": "SECURE_HSTS_SECONDS = 0",
    "HDR-005": "SECURE_SSL_REDIRECT = False",
    "HDR-006": "Content-Security-Policy: *",
    "SEC-ENT": f'hmac_key = "{RANDOM32}"',
}

# rule id -> snippets that look close and must not match
NEGATIVE = {
    "SEC-003": ['"AKIA123"', f'"AKIA{UPPER16}X"'],
    "SEC-008": ["'secrets'", "secret"],
    "SEC-012": ["password = os.environ['P']", 'password = ""'],
    "SEC-021": [f'STRIPE_KEY="{ALNUM24}"', f" STRIPE_KEY={ALNUM24} "],
    "INJ-002": ["execute('SELECT 1')"],
    "INJ-012": ["evaluate(x)", "eval(x)"],
    "INJ-020": ["box.innerHTML=''", "innerHTML"],
    "INJ-040": ["wait..."],
    "AUTH-020": ["@app.route('/a')\n@login\ndef a():"],
    "CRYPTO-001": ["codes(k)", "nodes(k)", "\xe9DES(k)"],
    "DBG-002": ["MYDEBUG = True", "DEBUG = False", "_DEBUG=True"],
    "NET-001": ['"http://localhost:80/x"', '"http://127.0.0.1/x"', '"http://example.com/x"', '"https://a.org/x"'],
    "NET-003": ["sameSite: 'none', secure: true"],
    "HDR-001": ["X-Frame-Options: ALLOWED", "X-Frame-Options: DENY"],
    "SEC-ENT": ['hmac_key = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"', 'hmac_key = "short"', f'colour = "{RANDOM32}"'],
}
