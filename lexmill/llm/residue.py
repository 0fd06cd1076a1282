"""Problem 8: template residue, filler and messages that stand where content should be.

Method: one grammar per delimiter finds unfilled fields, regular expressions find filler and messages, and the context
discounts what only speaks of them. Code spans and fenced code are taken out first, and sentences that explain templates are taken out before fields are
looked for. Where delimiters have hardly another use ({{x}}, ${x}, @@x@@, %x%, {x}, <x>) any name is a field's but for a tag's; where they have one, a name must
be known or in one piece (a_b), or stand where a sentence needs a noun ([x] after an article, a preposition or a label, and not a remark).
Messages are told by their shape: a line that begins with what a server, browser or session says, or that joins their nouns with what fails or is
required, and that has nothing of a report about it (quotation marks, courts, parties, evidence), however long it is. Filler counts by density: five Latin filler words
or four times the same word in a row.

All of it is Catalyst: two regexp_replace, a translate and a few rlike over one column, no Python, no shuffle.

Defined cases: null, empty and blank texts have no residue; extra columns pass through.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields in forms of legal cases, in the languages of the corpus; a blank stands for a blank, `_` or nothing.
FIELD_NAMES = (
    "court", "judge", "address", "witness", "counsel", "signatory", "party name", "case number", "due date", "bank account",
    "claim amount", "clause no", "hearing date", "first name", "last name", "full name", "client name", "phone number", "amount", "name", "date",
    "案号", "当事人姓名", "身份证号", "开庭日期", "法院名称", "代理人", "承办人", "住址", "开户行", "到期日", "诉讼请求金额", "签署人", "证人", "法官", "地址", "姓名", "日期", "金额", "电话",
    "Gericht", "Aktenzeichen", "Anschrift", "Streitwert", "Name der Partei", "Verhandlungstag", "Zeuge", "Richter", "Datum",
    "adresse", "tribunal", "nom de la partie", "date d audience", "montant réclamé", "numéro de dossier", "témoin", "juge",
    "juzgado", "domicilio", "nombre de la parte", "fecha de vista", "importe reclamado", "número de expediente", "testigo", "juez",
)
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
#: Filler sentences; each is taken where a sentence starts.
FILLER = (
    r"(?:正文|文字|段落|标题|内容|文本)内容?(?:(?:正文|文字|段落|标题|内容|文本)(?:内容)?){2,}",
    r"(?:此处|这里|本处)(?:为|是)(?:一段)?(?:示例|占位|测试|样例)(?:说明)?(?:文字|文本|内容)", r"(?:测试|占位|示例)(?:文本|文字)[，,]仅用于", r"请在定稿前替换",
    r"(?i:text text text)", r"(?i:dummy (?:paragraph|text)(?: used| to| for|[.!]))", r"(?i:sample text goes here)", r"(?i:(?:placeholder|filler) text (?:goes|to be|will be)|(?:your|insert) text here)",
    r"Blindtext (?:zur|für|zum)", r"Beispieltext Beispieltext", r"(?i:hier steht später)", r"(?i:text text text|platzhaltertext (?:zur|für))",
    r"Ici figurera le", r"(?i:texte texte texte)", r"(?i:(?:faux texte|texte (?:factice|de remplissage)) (?:pour|servant))",
    r"(?i:texto de (?:relleno|ejemplo|prueba) para)", r"(?i:texto texto texto)", r"Aquí irá el",
)
#: Messages of servers, browsers and sessions; each must start and fill a line.
MESSAGES = (
    # Chinese
    r"(?:抱歉|对不起|很遗憾|您好)?[，,！! ]*(?:您|你)?(?:没有|无权|暂无)(?:查看|访问|浏览|打开|操作).{0,16}(?:权限)?", r"(?:您|你)?(?:所)?(?:访问|请求|查看|打开)的(?:页面|文件|文书|内容|网页|资源).{0,8}(?:不存在|已被删除|无法|找不到|失效)[^\n]*",
    r"(?:该|此)?页面(?:不存在|未找到|加载失败|无法显示|走丢)[^\n]*", r"(?:服务器|系统|网关|服务|网络|数据库)(?:内部)?(?:错误|繁忙|超时|异常|维护|不可用|暂时不可用|连接失败)[^\n]*", r"(?:请求|连接|加载)(?:超时|失败|出错)[^\n]*",
    r"(?:您的)?(?:登录|会话)已?(?:超时|过期|失效)[^\n]*", r"正在(?:验证|检查|检测)您的?(?:浏览器|身份|连接)[^\n]*", r"(?:请|需要?|必须)(?:先)?(?:启用|开启|打开|允许).{0,10}(?:脚本|JavaScript|Cookie)[^\n]*",
    r"(?:本|该|此)(?:系统|页面|网站|查看器)(?:需要|要求|依赖).{0,6}(?:脚本|JavaScript|Cookie)[^\n]*", r"(?:当前|您的)浏览器.{0,6}(?:已?禁用|不支持|未启用|阻止).{0,8}(?:脚本|JavaScript|Cookie)[^\n]*", r"(?:请)?(?:完成|通过)(?:人机|安全)验证[^\n]*",
    # English
    r"(?:scripts|cookies|javascript) (?:are|is) (?:blocked|disabled|required|turned off|switched off)[^\n]*", r"(?:this|the) (?:viewer|page|site|portal|application|document) (?:needs|requires) (?:javascript|cookies|scripts)[^\n]*",
    r"(?:please )?(?:turn on|enable|allow|activate|switch on) (?:javascript|cookies|scripts)[^\n]*", r"(?:javascript|cookies) must be (?:enabled|allowed|on)[^\n]*", r"(?:checking|verifying) (?:that|if|whether|your).{0,20}(?:robot|human|browser|connection)[^\n]*",
    r"we could not (?:load|find|open|display) (?:this|the|that) [^\n]*", r"(?:error )?[45]\d\d ?[-–:]? ?(?:the requested (?:file|page)|internal (?:server )?error|not found|page not found|forbidden|bad gateway|gateway time-?out|service unavailable)[^\n]*",
    r"(?:the )?(?:page|file|document) (?:you requested )?(?:was|could) not (?:be )?found[^\n]*", r"(?:unhandled|uncaught) exception in [^\n]*", r"access (?:to this \w+ (?:is|was) )?denied[:.][^\n]*", r"access denied", r"(?:internal server error|service (?:temporarily )?unavailable|bad gateway|gateway time-?out)\b[^\n]*",
    r"your session (?:has|is) (?:ended|expired|timed out)[^\n]*", r"(?:please )?(?:log|sign) in again[^\n]*", r"too many requests[^\n]*", r"something went wrong[^\n]*",
    # German
    r"zum (?:lesen|anzeigen) (?:sind|ist) (?:skripte|javascript|cookies)[^\n]*", r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:javascript|cookies|skripte)[^\n]*", r"ihre sitzung ist (?:abgelaufen|beendet)[^\n]*", r"(?:der|dieser) dienst ist (?:vorübergehend |derzeit )?nicht (?:erreichbar|verfügbar)[^\n]*",
    r"fehler \d{3}\b[^\n]*", r"(?:die )?seite (?:wurde )?nicht gefunden[^\n]*", r"zugriff verweigert[^\n]*", r"(?:interner serverfehler|dieser browser (?:blockiert|unterstützt))[^\n]*", r"wir prüfen,? ob sie (?:ein mensch|kein roboter)[^\n]*",
    # French
    r"erreur \d{3}\b[^\n]*", r"(?:les )?(?:scripts|cookies) sont (?:désactivés|bloqués)[^\n]*", r"javascript est (?:désactivé|requis|nécessaire)[^\n]*", r"(?:veuillez )?(?:activez|activer|autorisez|autoriser) (?:javascript|les scripts|les cookies)[^\n]*", r"votre session (?:a expiré|est terminée)[^\n]*",
    r"(?:ce )?service (?:est )?(?:momentanément|temporairement) indisponible[^\n]*", r"(?:cette )?page (?:est )?introuvable[^\n]*", r"accès (?:refusé|interdit)[^\n]*", r"(?:nous )?vérifi(?:ons|cation) (?:que vous n|de votre navigateur)[^\n]*",
    # Spanish
    r"error \d{3}\b[^\n]*", r"(?:por favor,? )?(?:active|activa|habilite|permita) (?:javascript|las cookies|los scripts|scripts|cookies)[^\n]*", r"(?:este|el) (?:visor|sitio|portal) (?:necesita|requiere) .{0,20}(?:scripts|javascript|cookies)[^\n]*", r"(?:la|su) sesión ha (?:caducado|expirado|terminado)[^\n]*",
    r"el servicio no está disponible[^\n]*", r"(?:la )?página no (?:encontrada|disponible|existe)[^\n]*", r"acceso (?:denegado|no autorizado)[^\n]*", r"(?:los )?(?:scripts|cookies) están (?:bloquead|desactivad)[oa]s[^\n]*", r"comprobando (?:que|si) (?:no )?(?:es|eres|usted)[^\n]*",
)

_CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]++`"
#: Sentences that explain templates, and what a line says that reports on a message rather than being one.
_TUTORIAL = r"(?iu)[^\n.!?。！？；;]*(?:placeholder|merge field|in the template|the template|platzhalter|textbaustein|in der vorlage|die vorlage|espace réservé|champ de fusion|le modèle de|dans le modèle|la plantilla|marcador de posición|占位|模板)[^\n.!?。！？]*"
_TUTORIAL_WORDS = ("laceholder", "emplate", "erge field", "latzhalter", "extbaustein", "orlage", "espace réservé", "champ de fusion", "modèle", "plantilla", "marcador", "占位", "模板")
_REPORT = r"[“”\"«»「」『』„]|(?:court|claimant|defendant|plaintiff|witness|exhibit|counsel|evidence|testif|stated|screenshot|hearing|contract)|法院|原告|被告|证人|证据|截图|合同|公司|当事人|gericht|kläger|beklagt|zeuge|beweis|tribunal|demand(?:eur|eresse)|témoin|pièce|juzgado|demandad|actora|testigo|prueba"
#: Names that `<x>` may have as a tag (fixed values of HTML).
_TAGS = "a abbr article aside audio b big blockquote body br button canvas caption center cite code col dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split()


#: Words after which a sentence needs a noun, and what bracketed remarks begin with.
_BEFORE_NOUN = "the|an?|of|to|by|from|for|with|between|and|or|at|dear|mrs?|ms|der|die|das|dem|den|des|von|vom|zum|zur|mit|für|und|zwischen|le|la|les|du|de|au|aux|et|par|pour|avec|entre|el|los|las|del|al|y|con|por|para"
_REMARK = r"(?:sic|emphasis|italics|original|added|omitted|illegible|unintelligible|inaudible|redacted|signature|signed|stamp|seal|translat|page|figure|table|note|pause|laugh|blank|unleserlich|unterschrift|hervorh|auslassung|geschwärzt|siegel|stempel|illisible|souligné|tampon|traduction|ilegible|firma|sello|énfasis|traducci|原文|签名|盖章|印章|不清|略|注|附图|图|表|页|字迹)"


def _name() -> str:
    names = sorted({n for n in FIELD_NAMES}, key=len, reverse=True)
    return "(?:" + "|".join("[ _'’]?".join(re.escape(p) for p in n.split(" ")) for n in names) + ")"


def field_patterns() -> list[tuple[tuple[str, ...], str]]:
    """Unfilled fields, a grammar for each kind of delimiters, with the strings of which a text that has one holds at least one."""
    name, word = _name(), r"[\p{L}][\p{L}\p{N}_.'’ -]{0,38}"
    joined = r"(?:\p{L}+(?:_\p{L}+)+)"  # names in one piece, which prose hasn't
    loose = rf"(?:(?iu:{name})|{joined})"
    return [
        (("{{",), rf"\{{\{{-?\s*{word}\s*-?\}}\}}"),
        (("${", "#{"), r"[$#]\{[\p{L}][\p{L}\p{N}_.]{0,38}\}"),
        (("@@",), rf"@@{word}@@"),
        (("%",), rf"(?<![\p{{N}}%\s])%%?(?:\p{{L}}[\p{{L}}_]{{1,38}}|{loose})%|(?<=\s)%(?:\p{{L}}[\p{{L}}_]{{1,38}}|{loose})%|^%(?:\p{{L}}[\p{{L}}_]{{1,38}}|{loose})%"),
        (("__",), rf"(?<!_)__(?:\p{{Lu}}[\p{{Lu}}_]{{1,37}}\p{{Lu}}|{loose})__(?!_)"),
        (("<<",), rf"<<\s*{word}\s*>>"),
        (("<",), rf"(?iu)<(?!(?:{'|'.join(_TAGS)})>)(?:{loose}|\p{{L}}{{2,}}(?:[ _-]\p{{L}}{{2,}}){{0,3}})>"),
        (("«",), rf"«{loose}»"),
        (("{",), rf"(?u)(?<![{{$#\\])\{{(?:{loose}|\p{{L}}{{2,}}(?:[ _.-]\p{{L}}{{2,}}){{0,3}})\}}(?!\}})"),
        (("[",), rf"(?<!\[)\[(?iu:{name})\](?![\](])"),
        (("[",), rf"(?iu)(?:^|[:：]|\b(?:{_BEFORE_NOUN}))[ \t]*+\[(?!\[)(?!{_REMARK})\p{{L}}{{3,}}(?:[ _'’-]\p{{L}}{{2,}}){{0,3}}\](?![\](\[:])"),
        (("[",), r"(?iu)\[(?:insert|enter|fill in|bitte|insertar|indicar|insérer|indiquer|compléter|à compléter|hier) [^\[\]\n]{2,40}\]"),
        (("[",), r"(?iu)\[[^\[\]\n]{2,36} (?:to be (?:completed|filled in|inserted|confirmed)|einsetzen|eintragen|ergänzen|por completar|à compléter)\]"),
        ((" here)",), r"(?iu)\((?:fill in|insert|enter) [^()\n]{2,40} here\)"),
        (("请", "填写"), r"[【\[（(](?:请填写|请输入|此处填写|待填写|请补充)[^【】（）()\[\]\n]{1,24}[】\]）)]"),
        (("待",), r"[【\[（(][^【】（）()\[\]\n]{1,24}(?:待补充|待填写|待填)[】\]）)]"),
    ]


def latin_pattern() -> str:
    """Five or more filler words with no other between them, from the start of a sentence."""
    word = "(?:" + "|".join(sorted(LATIN, key=len, reverse=True)) + ")"
    return rf"(?im)(?:^|[.。!！?？])\s*{word}(?:[ \t,;]+{word}(?![a-z])){{4,}}"


def message_pattern() -> str:
    """A line that is a message: by how it begins, or by what it joins; never a report."""
    edge = r"[^\n\p{L}\p{N}]{0,6}+"
    web = r"(?:java ?script|cookies?|browser|navigateur|navegador|server|serveur|servidor|session|sitzung|sesión|web ?page|website|gateway|captcha|robot|login|page|seite|request|scripts?|skripte|脚本|浏览器|服务器|会话|网页|页面|验证码)"
    fails = r"(?:enabled?|disabled|blocked|not support(?:ed)?|requires?d?|needs?|must|denied|not (?:be )?found|could not (?:be |load|open|find|display|connect|process|verify|reach)|cannot|can't|unavailable|expired|timed out|went wrong|forbidden|try again|verify|checking|aktivier|erforderlich|deaktiviert|abgelaufen|nicht (?:gefunden|verfügbar|erreichbar)|activ(?:er|ez)|désactivé|expiré|introuvable|indisponible|vérifi|habilit|desactivad|caducad|no (?:encontrad|disponible)|启用|禁用|不存在|错误|超时|过期|失效|无法|繁忙|验证)"
    starts = r"(?:you|your|please|sorry|oops|this|we|bad|error|internal|access|too many|one moment|just a moment|loading|enable|sie|ihr|ihre|bitte|diese|dieser|leider|vous|votre|veuillez|cette|ce|désolé|usted|su|por favor|este|esta|lo sentimos|您|请|抱歉|对不起|系统|当前|本)"
    codes = r"(?:bad request|not found|forbidden|unauthorized|request timeout|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests)"
    joined = rf"{starts}\b?(?=[^\n.!?。！？]*{web})(?=[^\n.!?。！？]*{fails})(?![^\n.!?。！？]{{160}})|(?:error )?(?:[45]\d\d[ :.–-]+)?{codes}(?=[.:!–-]|\s*$)"
    return rf"(?imu)^(?={edge}(?:(?:{'|'.join(MESSAGES)})[\s.。!！…]*$|{joined}))(?![^\n]*(?:{_REPORT}))"


def filler_pattern() -> str:
    return r"(?m)(?:^|[\n.。!！?？])\s*(?:" + "|".join(FILLER) + r")|(?iu)\b(\p{L}{3,})(?:[ \t]+\1\b){3,}"


def normalised(text: Column) -> Column:
    """A text without code and invisible characters, with ideographs for their radical forms and letters for full-width ones."""
    forms = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0x2F00, 0x2FD6), *range(0xFF21, 0xFF5B)])}
    forms = {c: f for c, f in forms.items() if c != f and len(f) == 1} | {"\u00a0": " ", "\u2007": " ", "\u202f": " "}
    gone = [0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF]
    odd = r"[\u00A0\u00AD\u2007\u200B-\u200F\u202F\u2060-\u2064\u2F00-\u2FD5\uFEFF\uFF21-\uFF5A]"
    bare = F.when(F.contains(text, F.lit("`")) | F.contains(text, F.lit("~~~")), F.regexp_replace(text, _CODE, " ")).otherwise(text)
    return F.when(bare.rlike(odd), F.translate(bare, "".join(forms) + "".join(map(chr, gone)), "".join(forms.values()))).otherwise(bare)


def _any(column: Column, parts) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(column, F.lit(p)) for p in parts))


def has_field(clean: Column) -> Column:
    """Whether a normalised text has an unfilled field outside of sentences that explain templates."""
    told = F.when(_any(clean, _TUTORIAL_WORDS), F.regexp_replace(clean, _TUTORIAL, " ")).otherwise(clean)
    return F.exists(F.array(told), _field)


def _field(clean: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, (_any(clean, parts) & clean.rlike(pattern) for parts, pattern in field_patterns()))


def has_filler(clean: Column) -> Column:
    return clean.rlike(filler_pattern()) | clean.rlike(latin_pattern())


def has_message(clean: Column) -> Column:
    return clean.rlike(message_pattern())


def has_residue(text: Column) -> Column:
    """True, false or, for a null text, null. The lambda's variable makes that the normalised text is made once for a row."""
    return F.exists(F.array(normalised(text)), lambda c: has_field(c) | has_filler(c) | has_message(c))


def kinds(text: Column) -> Column:
    """Array of the kinds of residue in a text: `field`, `filler`, `message`."""
    each = F.transform(
        F.array(normalised(text)),
        lambda c: F.array(F.when(has_field(c), "field"), F.when(has_filler(c), "filler"), F.when(has_message(c), "message")),
    )
    return F.filter(each[0], lambda k: k.isNotNull())


def find_residue(df: DataFrame, text_col: str = "text", out: str = "residue") -> DataFrame:
    """Rows with residue, with its kinds in `out`."""
    return df.filter(has_residue(F.col(text_col))).withColumn(out, kinds(F.col(text_col)))


def exclude_residue(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows without residue (null and blank texts stay), with the columns of df."""
    return df.filter(~F.coalesce(has_residue(F.col(text_col)), F.lit(False)))
