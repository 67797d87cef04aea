"""Tables of the flow rules: kinds of sinks, inputs, calls that are sinks, sanitizers, guards and calls that change what they are called on."""

from __future__ import annotations

# Flows: kinds of sinks with weakness, category, severity, confidence.
SINKS = {"sql": ("CWE-89", "sql_injection", "high", "high"), "cmd": ("CWE-78", "command_injection", "critical", "high"), "path": ("CWE-22", "path_traversal", "high", "high"), "ssrf": ("CWE-918", "ssrf", "high", "medium"), "redirect": ("CWE-601", "open_redirect", "medium", "medium"), "ssti": ("CWE-1336", "ssti", "high", "high"), "log": ("CWE-117", "log_injection", "medium", "medium")}
KEY_NAMES = {"sql": "sql-injection-taint", "cmd": "command-injection-taint", "path": "path-traversal-taint", "ssrf": "ssrf-taint", "redirect": "open-redirect-taint", "ssti": "ssti-taint", "log": "log-injection-taint"}
FAMILY = {"python": "py", "javascript": "js", "typescript": "js", "tsx": "js", "java": "java", "kotlin": "kotlin", "go": "go", "csharp": "cs", "rust": "rust"}
LACKING = {("kotlin", "ssti"), ("rust", "path"), ("rust", "ssti"), ("rust", "log")}

# Inputs by family: expressions over the text of a value.
SOURCES = {
    "py": r"\brequest\.(args|form|values|json|data|files|cookies|headers|GET|POST|query_params|get_json)\b|\binput\s*\(|\bsys\.argv\b|\bos\.environ\b",
    "js": r"\b(req|request|ctx)\.(query|params|body|cookies|headers)\b|\blocation\.(search|hash|href)\b|\bprocess\.argv\b|\bsearchParams\.get\(",
    "java": r"\.(getParameter|getParameterValues|getHeader|getQueryString|getCookies|getInputStream|getReader)\s*\(",
    "kotlin": r"\.(getParameter|getHeader|getQueryString)\s*\(|\bcall\.(parameters|receiveText|receive)\b|\breadLine\s*\(",
    "go": r"\.(FormValue|PostFormValue|URL\.Query\(\)\.Get|Query\(\)\.Get|PathValue|Header\.Get|Param|QueryParam|Query)\s*\(|\bos\.Args\b",
    "cs": r"\bRequest\.(Query|Form|Headers|Cookies|Params|QueryString|Body|RouteValues)\b|\bConsole\.ReadLine\s*\(",
    "rust": r"\b(env::args|stdin\(\)|query_string\(\)|req\.(query|body|param|headers))|\.match_info\(\)|\bQuery\(|\bPath\(|\bForm\(",
}
PARAM_SOURCES = {"java": r"@(RequestParam|PathVariable|RequestBody|RequestHeader)\b", "cs": r"\[From(Query|Body|Route|Header|Form)\]", "kotlin": r"@(RequestParam|PathVariable|RequestBody)\b"}
# Sinks by family and kind: callee, receiver, argument that counts (-1: any), whether it writes.
CALLS: dict[str, list[tuple[str, str, str, int, bool]]] = {
    "py": [("sql", r"^(execute|executemany|executescript|raw)$", r".", 0, False), ("cmd", r"^(system|popen|getoutput|run|call|check_output|check_call|Popen)$", r"^(os|subprocess|commands)$", 0, False), ("path", r"^open$", r"^(|io|codecs)$", 0, False), ("path", r"^(remove|unlink|rename|rmtree|copy|copyfile|move|makedirs)$", r"^(os|shutil)$", 0, True), ("path", r"^(send_file|send_from_directory|FileResponse)$", r"", -1, False), ("ssrf", r"^(get|post|put|delete|head|patch|request|urlopen)$", r"^(requests|httpx|urllib\.request|urllib|session)$", -1, False), ("redirect", r"^(redirect|RedirectResponse|HttpResponseRedirect)$", r"", 0, False), ("ssti", r"^(render_template_string|from_string|Template)$", r"", 0, False), ("log", r"^(debug|info|warning|error|critical|exception|log)$", r"(?i)(log|logger|logging)$", -1, False)],
    "js": [("sql", r"^(query|execute|raw)$", r".", 0, False), ("cmd", r"^(exec|execSync|spawn|spawnSync|execFile)$", r"", 0, False), ("path", r"^(readFile|readFileSync|createReadStream|sendFile)$", r"", 0, False), ("path", r"^(writeFile|writeFileSync|createWriteStream|unlink|unlinkSync|rm|rmSync)$", r"", 0, True), ("ssrf", r"^(fetch|get|post|request|axios)$", r"^(|axios|http|https|got|needle)$", 0, False), ("redirect", r"^redirect$", r"(res|response|ctx)$", -1, False), ("ssti", r"^(compile|render|renderString)$", r"(?i)(handlebars|ejs|pug|nunjucks|_)$", 0, False), ("log", r"^(log|info|warn|error|debug)$", r"(?i)(console|logger|log)$", -1, False)],
    "java": [("sql", r"^(executeQuery|executeUpdate|execute|prepareStatement|createQuery|createNativeQuery|queryForObject|queryForList|query|update)$", r".", 0, False), ("cmd", r"^(exec|ProcessBuilder|command)$", r"", -1, False), ("path", r"^(File|FileInputStream|FileReader|RandomAccessFile)$", r"", -1, False), ("path", r"^(FileOutputStream|FileWriter|PrintWriter)$", r"", -1, True), ("path", r"^(get|of|readAllBytes|readString|newInputStream|lines)$", r"^(Paths|Path|Files)$", -1, False), ("path", r"^(write|writeString|delete|copy|move|newOutputStream)$", r"^Files$", 0, True), ("ssrf", r"^(URL|openConnection|getForObject|getForEntity|exchange|create)$", r"^(|URI|restTemplate|new URL.*)$", 0, False), ("redirect", r"^(sendRedirect|RedirectView)$", r"", 0, False), ("ssti", r"^(evaluate|process|parseExpression|mergeTemplate)$", r"", -1, False), ("log", r"^(trace|debug|info|warn|error)$", r"(?i)(log|logger)$", -1, False)],
    "kotlin": [("sql", r"^(executeQuery|executeUpdate|execute|prepareStatement|rawQuery|execSQL|createNativeQuery)$", r".", 0, False), ("cmd", r"^(exec|ProcessBuilder)$", r"", -1, False), ("path", r"^(File|FileInputStream)$", r"", -1, False), ("path", r"^(FileOutputStream|FileWriter|writeText|writeBytes)$", r"", -1, True), ("ssrf", r"^(URL|URI)$", r"", 0, False), ("redirect", r"^(sendRedirect|respondRedirect)$", r"", 0, False), ("log", r"^(trace|debug|info|warn|error)$", r"(?i)(log|logger)$", -1, False)],
    "go": [("sql", r"^(Query|QueryRow|Exec|Prepare)$", r".", 0, False), ("sql", r"^(QueryContext|QueryRowContext|ExecContext)$", r".", 1, False), ("cmd", r"^(Command|CommandContext)$", r"^exec$", -1, False), ("path", r"^(Open|ReadFile|OpenFile|Stat)$", r"^(os|ioutil)$", 0, False), ("path", r"^(WriteFile|Create|Remove|RemoveAll|Mkdir|MkdirAll)$", r"^(os|ioutil)$", 0, True), ("path", r"^ServeFile$", r"^http$", 2, False), ("ssrf", r"^(Get|Post|Head|PostForm|NewRequest)$", r"^http$", -1, False), ("redirect", r"^Redirect$", r"", -1, False), ("ssti", r"^Parse$", r"[Tt]emplate", 0, False), ("log", r"^(Print|Printf|Println|Fatal|Fatalf)$", r"^log$", -1, False)],
    "cs": [("sql", r"^(SqlCommand|NpgsqlCommand|MySqlCommand|SqliteCommand|FromSqlRaw|ExecuteSqlRaw|ExecuteSqlRawAsync|Query|Execute)$", r"", 0, False), ("cmd", r"^(Start|ProcessStartInfo)$", r"^(|Process)$", -1, False), ("path", r"^(ReadAllText|ReadAllBytes|OpenRead|Open|FileStream|StreamReader|PhysicalFile)$", r"^(|File|System\.IO\.File)$", 0, False), ("path", r"^(WriteAllText|WriteAllBytes|Delete|Move|Copy|AppendAllText|Create)$", r"^(File|Directory|System\.IO\.File)$", 0, True), ("ssrf", r"^(GetAsync|GetStringAsync|PostAsync|GetStreamAsync|DownloadString|Create)$", r"(?i)(client|http|WebRequest)", 0, False), ("redirect", r"^(Redirect|RedirectPermanent)$", r"", 0, False), ("ssti", r"^(Parse|Compile|RunCompile)$", r"(?i)(template|razor|engine)", 0, False), ("log", r"^Log(Trace|Debug|Information|Warning|Error|Critical)$", r"", -1, False)],
    "rust": [("sql", r"^(query|query_as|sql_query|prepare|query_row|batch_execute)$", r"", 0, False), ("sql", r"^execute$", r".", 0, True), ("cmd", r"^(arg|args)$", r"Command::new", -1, False), ("cmd", r"^new$", r"Command$", 0, False), ("ssrf", r"^(get|post|put|delete)$", r"^(reqwest|reqwest::blocking|client)$", 0, False), ("redirect", r"^(to|temporary|permanent)$", r"Redirect$", 0, False)],
}
SANITIZERS = {"": r"\b(Integer\.parseInt|Long\.parseLong|strconv\.Atoi|strconv\.ParseInt|int\.Parse|Guid\.Parse|UUID\.fromString|int|float|Number|parseInt|parseFloat|toInt|parse::<)\b", "cmd": r"\b(shlex\.quote|quote|escapeshellarg|shellescape)\b", "path": r"\b(secure_filename|basename|path\.basename|filepath\.Base|Path\.GetFileName|getFileName|FilenameUtils\.getName)\b", "log": r"\b(replace|replaceAll|encode|strip|escape\w*)\s*\(", "redirect": r"\b(url_for|is_safe_url|url_has_allowed_host_and_scheme)\b", "ssrf": r"\bvalidate_url\b", "sql": r"\b(escape|quote_ident|mysql_real_escape_string)\b", "ssti": r"\bescape\b"}
GUARDS = {"path": r"^(startswith|startsWith|StartsWith|HasPrefix|starts_with|is_relative_to)$"}
# Calls that put their arguments into what they are called on, by family.
MUTATORS = {
    "py": r"^(append|extend|insert|update|add|write)$", "js": r"^(push|unshift|append|set|add|write)$", "java": r"^(append|insert|add|addAll|put|putAll|write|print|println|format)$", "kotlin": r"^(append|add|put|insert)$",
    "go": r"^(WriteString|Write|WriteByte|WriteRune|Add|Set)$", "cs": r"^(Append|AppendLine|AppendFormat|Insert|Add|AddRange|Write|WriteLine)$", "rust": r"^(push_str|push|extend|extend_from_slice|insert|write_str|write_all)$",
}
