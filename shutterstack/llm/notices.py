"""Phrases of script notices, error pages and filler in eleven languages, composed from what such notices are made of.

A notice says what is missing (a name), what is the matter with it (a verb or a state), and for whom or what. The firm phrases
tell what kind of notice it is; the loose ones are what stands between them and count only beside enough firm ones.
"""

from __future__ import annotations

from itertools import product

SCRIPT, ERROR, FILLER, SHOWN, LOOSE = 1, 2, 4, 8, 16

# Fixed values, by language: {} is the name of what is missing. "script" and "error" are firm, "loose" is not. Where a value has
# several lists, every combination of their entries is a phrase, joined by the separator at the end.
NAMES = {
    "": ["javascript", "java script", "js"],
    "en": ["javascript", "java script", "js", "scripts", "scripting", "script", "client-side scripting", "client-side scripts", "a script-enabled browser", "browser scripts", "javascript and cookies", "cookies and javascript"],
    "fr": ["javascript", "le javascript", "les scripts"], "es": ["javascript", "los scripts"], "it": ["javascript", "gli script"], "pt": ["javascript", "o javascript", "os scripts"], "ru": ["javascript", "скрипты", "поддержку javascript"],
    "de": ["javascript", "kein javascript", "skripte"], "pl": ["javascript", "obsługi javascript", "obsługę javascript"],
}
SCRIPT_FRAMES = {
    "en": [
        "needs {}", "requires {}", "uses {}", "{} turned off", "works with {}", "by enabling {}", "require {}", "relies on {}", "depends on {}", "works only with {}", "only works with {}", "does not work without {}", "doesn't work without {}", "will not work without {}", "won't work without {}", "does not work properly without {}",
        "doesn't work properly without {}", "cannot be shown without {}", "can't be shown without {}", "cannot be displayed without {}", "can't be displayed without {}", "cannot be used without {}", "without {}", "was not drawn because it depends on {}", "this takes {}", "need {}",
        "enable {}", "activate {}", "turn on {}", "switch on {}", "allow {}", "turn {} on", "switch {} on", "have {} enabled", "have {} turned on", "with {} enabled", "without {} enabled", "{} to be enabled", "{} to be turned on", "{} did not load", "the widget {} did not load",
        "does not support {}", "doesn't support {}", "no {} support", "browser has {} disabled", "cookies and {} have to be allowed", "{} is required", "{} is needed", "{} required", "{} disabled",
    ],
    "de": [
        "benötigt {}", "aktivieren sie {} in den einstellungen", "{} wurde blockiert", "{} ist blockiert", "nur mit {}", "verwendet {}", "{} einschalten", "{} aktivieren", "braucht {}", "erfordert {}", "setzt {} voraus", "wird {} benötigt", "{} wird benötigt", "{} ist erforderlich", "{} ist deaktiviert", "{} ist nicht aktiviert", "{} ist ausgeschaltet", "{} muss aktiviert sein", "{} muss eingeschaltet sein", "{} muss aktiviert werden",
        "aktivieren sie bitte {}", "bitte aktivieren sie {}", "aktivieren sie {}", "schalten sie {}", "bitte schalten sie {}", "schalte {}", "aktiviere {}", "unterstützt {}", "unterstützt {} nicht", "ohne {}", "{} zulassen", "erlauben sie {}",
    ],
    "fr": [
        "nécessite {}", "{} de votre navigateur est désactivé", "utilise {}", "fonctionne qu'avec {}", "{} désactivé", "requiert {}", "a besoin de {}", "activer {}", "activez {}", "veuillez activer {}", "merci d'activer {}", "autorisez {}", "autoriser {}", "{} est désactivé", "{} est requis", "{} est nécessaire", "{} doit être activé", "{} n'est pas activé", "ne prend pas en charge {}", "ne supporte pas {}", "sans {}",
    ],
    "es": [
        "requiere {}", "utiliza {}", "solo funciona con {}", "{} desactivado", "activando {}", "necesita {}", "se requiere {}", "habilite {}", "habilitar {}", "active {}", "activar {}", "activa {}", "permita {}", "{} está desactivado", "{} está deshabilitado", "{} es necesario", "{} debe estar activado", "{} no está habilitado", "{} no está activado", "no soporta {}", "no admite {}", "no es compatible con {}", "sin {}",
    ],
    "it": ["richiede {}", "{} disattivato", "attivare {}", "utilizza {}", "funziona solo con {}", "{} disabilitato", "abilitando {}", "ha bisogno di {}", "abilita {}", "abilitare {}", "abilitate {}", "attiva {}", "attivare {}", "attivate {}", "{} è disabilitato", "{} è disattivato", "{} è necessario", "{} è richiesto", "{} deve essere attivato", "{} non è abilitato", "non supporta {}", "senza {}"],
    "pt": ["requer {}", "utiliza {}", "só funciona com {}", "{} desativado", "ativando {}", "precisa de {}", "exige {}", "necessita de {}", "ative {}", "ativar {}", "habilite {}", "habilitar {}", "{} está desativado", "{} está desabilitado", "{} é necessário", "{} deve estar ativado", "{} não está ativado", "não suporta {}", "não é compatível com {}", "sem {}"],
    "ru": ["требуется {}", "использует {}", "работает только с {}", "включённым {}", "требует {}", "нужен {}", "необходим {}", "включите {}", "включить {}", "разрешите {}", "{} отключен", "{} отключён", "{} выключен", "{} не включен", "{} должен быть включен", "не поддерживает {}", "без {}"],
    "zh": ["启用{}", "使用{}", "关闭了{}", "开启{}", "打开{}", "允许{}", "需要{}", "不支持{}", "{}已禁用", "{}被禁用", "{}未启用", "没有{}", "请启用{}", "请开启{}", "需要启用{}"],
    "ja": ["{}を有効にしてください", "{}を有効にする必要があります", "{}を使用", "{}がオフ", "{}を有効に", "{}をオンに", "{}が必要です", "{}が無効", "{}が無効になっています", "{}が有効になっていません", "{}に対応していません", "{}をサポートしていません"],
    "nl": ["vereist {}", "zet {} aan", "heeft {} nodig", "schakel {} in", "zet {} aan", "{} inschakelen", "{} is uitgeschakeld", "{} is vereist", "{} moet ingeschakeld zijn", "ondersteunt geen {}", "zonder {}"],
    "pl": ["wymaga {}", "wymaga włączonej {}", "włącz {}", "włączyć {}", "{} jest wyłączony", "{} jest wymagany", "{} musi być włączony", "nie obsługuje {}", "bez {}"],
}
#: Composed states of scripts: name, form of to be, state.
SCRIPT_BE = ["is", "are", "was", "must be", "has to be", "have to be", "needs to be", "need to be", "should be", "has been", "have been", "seems to be", "appears to be", "is currently", "is not", "isn't", "are not", "looks like it is"]
SCRIPT_STATES = ["turned on", "turned off", "switched on", "switched off", "enabled", "disabled", "activated", "deactivated", "allowed", "blocked", "active", "available", "available in your browser", "supported", "required", "needed", "missing"]
SCRIPT_WHOLE = [
    "output is hidden because {} is off", "because {} is off", "{} is off",
    "supported browser", "blocks {}", "blocking {}", "{} execution is turned off", "{} wurde blockiert", "browser blocks {}",
    "outdated browser", "unsupported browser", "browser is not supported", "browser is out of date", "browser is no longer supported", "upgrade your browser", "update your browser", "either doesn't support {} or you have it turned off", "you have it turned off", "you have it disabled",
    "checking your browser before opening the page", "checking your browser", "check your browser", "checking if the site connection is secure", "verifying you are human", "a widget should appear here", "if you see this message", "loading notebook viewer", "loading the viewer", "interactive figure:",
    "the viewer can't start without it", "the viewer cannot start without it", "some parts of this page will not be shown", "turn it on and reload", "turn it on to continue", "please switch it on", "switch it on and reload", "reload when ready", "allow it in the settings and reload", "it looks like {} is turned off", "your browser has {} disabled",
]
SCRIPT_LOOSE = [
    "please enable", "to continue", "in your browser", "to view this notebook", "to view this page", "to display it", "to display this output", "to display this content", "to run this app", "you need to enable", "um diesen inhalt anzuzeigen", "pour afficher ce contenu", "para ver este contenido",
]

ERROR_SUBJECTS = [
    "this page", "this site", "this document", "this notebook", "this output", "this widget", "this figure", "this content", "this view", "the page", "the notebook", "the viewer", "the preview", "the map below", "the map", "the figure below", "the chart below", "the interactive table", "the interactive figure", "the widget", "the output",
    "the requested file", "the requested page", "the kernel gateway", "the shared workspace", "the document", "the server", "this repository", "the site", "the website", "this website", "the file", "this file", "the content", "this video", "this item", "this account", "the requested url", "the requested resource", "the resource", "this resource",
    "the service", "this service", "your request", "the request", "the connection", "your session", "the url", "this link", "the link", "the application", "this application", "this app", "the app",
]
ERROR_FRAMES = [
    "is down for maintenance", "is under maintenance", "is undergoing scheduled maintenance", "is undergoing maintenance", "is temporarily unavailable due to maintenance", "is private", "is down", "is unreachable", "is unavailable", "is overloaded", "is busy", "has been removed or is private", "has been removed", "has been deleted", "has been moved", "has been suspended",
    "may have been removed", "may have been moved", "returned an unexpected error", "encountered an internal error", "encountered an error", "took too long to respond", "failed to open", "failed to load", "has expired", "timed out", "has timed out", "has moved", "does not exist", "doesn't exist", "no longer exists", "no longer available", "is no longer available",
    "was refused", "was reset", "was interrupted", "did not answer in time", "is not responding", "isn't responding", "refused to connect",
]
ERROR_NOT = ["is not", "isn't", "was not", "wasn't", "are not", "could not be", "couldn't be", "cannot be", "can not be", "can't be", "can no longer be", "was unable to be", "is currently not", "is temporarily not"]
ERROR_STATES = ["available", "available right now", "available at the moment", "accessible", "reachable", "found", "found on this server", "loaded", "reached", "displayed", "shown", "opened", "rendered", "served", "processed", "completed", "located", "retrieved", "accessed", "established", "fulfilled"]
ERROR_HOW = ["is temporarily", "is currently", "is presently", "is momentarily", "are temporarily", "are currently"]
ERROR_BAD = ["unavailable", "overloaded", "offline", "down", "out of service", "unreachable", "unable to service your request", "unable to handle the request", "unable to process your request", "inaccessible"]
ERROR_WHOLE = {
    "en": [
        "not found", "cannot connect to the server", "cannot connect to the database", "connection to the server was lost", "connection was lost", "connection lost", "lost connection", "no connection", "session expired", "session has expired", "log in again", "log in to view", "sign in to view", "access restricted", "invalid response", "could not process your request", "come back later", "reached your request limit", "request limit", "limit exceeded", "quota exceeded", "temporarily unavailable", "currently unavailable", "link has expired", "has been archived", "server error", "server is down", "is broken", "may be broken", "isn't working", "is not working", "timed out responding", "request blocked", "can't connect to", "cannot connect to", "can't seem to find", "unable to access", "temporarily down", "down for maintenance", "is unavailable", "is not available", "could not find", "couldn't find", "cannot find", "can't find", "unable to find", "trouble finding", "trouble loading", "trouble connecting", "having trouble", "has been denied", "was denied", "is denied", "fetch failed", "request failed", "load failed", "failed to fetch", "failed to connect", "no internet", "you are offline", "you're offline", "nothing to see here", "nothing here", "went wrong", "technical difficulties", "experiencing problems", "experiencing issues", "slow down", "is empty or private", "not permitted", "invalid request", "page doesn't exist", "has been disabled", "has been blocked", "you have been blocked", "dead link", "broken link", "page not found", "bad gateway", "gateway timeout", "gateway time-out", "service unavailable", "internal server error", "internal error", "forbidden", "access denied", "access forbidden", "too many requests", "request timeout", "unauthorized", "bad request", "gone", "error", "http error", "server error", "database error",
        "file or directory not found", "retry", "reload?", "please try again later", "try again later", "please try again in a few minutes", "please try again", "please check back soon", "we'll be back soon", "be back soon", "contact support if this keeps happening", "go back to the overview", "refresh the page or come back in a few minutes", "check the address and try once more",
        "check the address and try again", "back to the start page", "if the problem persists, contact the administrator", "request id", "reference", "code", "nginx", "apache", "cloudflare", "oops!", "oops", "that page can't be found", "it may have been moved or deleted", "sorry, something went wrong", "something went wrong", "we had trouble rendering this notebook",
        "unable to render this document", "unable to render this notebook", "unable to complete your request", "unable to connect", "unable to load", "the backend did not answer in time", "log in again to see this page", "sign in again", "rate limit exceeded", "wait a moment before you load more notebooks", "you do not have permission", "you don't have permission",
        "you are not authorized", "permission denied", "sign in and try again", "you are requesting a notebook that does not exist", "upstream connect error or disconnect/reset before headers", "reset reason", "connection failure", "connection failed", "connection refused", "connection timed out", "connection reset", "timeout", "notice", "warning",
        "an error occurred", "an unexpected error occurred", "an error has occurred", "an unexpected error has occurred", "error establishing a database connection", "we are sorry", "we're sorry", "sorry", "there is a problem with", "there was a problem with", "due to maintenance downtime", "capacity problems", "scheduled maintenance", "under construction", "secure connection failed",
    ],
    "de": [
        "fehler", "wurde verweigert", "verweigert", "ist fehlgeschlagen", "fehlgeschlagen", "keine verbindung", "verbindung verloren", "verbindung unterbrochen", "link ist abgelaufen", "ist abgelaufen", "zugriff eingeschränkt", "bitte melden sie sich an", "server antwortet nicht", "antwortet nicht", "fehler ist aufgetreten", "nicht vorhanden", "laden sie die seite neu", "ist ein fehler aufgetreten", "nicht erreichbar", "nicht verfügbar", "etwas ist schiefgelaufen", "ist schiefgelaufen", "technische probleme", "technischen problemen", "nicht gefunden", "finden die seite nicht", "wegen wartungsarbeiten", "hoppla", "serverfehler", "interner serverfehler", "seite nicht gefunden", "datei nicht gefunden", "zugriff verweigert", "zeitüberschreitung", "es ist ein fehler aufgetreten", "ein fehler ist aufgetreten", "dienst nicht verfügbar", "bitte versuchen sie es später erneut", "bitte versuchen sie es später noch einmal", "versuchen sie es später", "sie haben keine berechtigung",
        "keine berechtigung", "existiert nicht", "existiert nicht mehr", "wurde nicht gefunden", "wurden nicht gefunden", "wurde entfernt", "wurde verschoben", "sitzung ist abgelaufen", "wartungsarbeiten", "nicht gefunden werden", "nicht geladen werden", "nicht angezeigt werden", "nicht geöffnet werden", "nicht erreicht werden",
    ],
    "fr": [
        "erreur", "connexion au serveur a échoué", "a échoué", "connexion perdue", "lien a expiré", "a expiré", "accès restreint", "connectez-vous pour", "serveur ne répond pas", "ne répond pas", "pas autorisé", "non autorisé", "problèmes techniques", "difficultés techniques", "un problème est survenu", "s'est mal passé", "introuvable", "oups", "rencontrons", "n'est pas accessible", "impossible de charger", "impossible d'afficher", "n'avons pas trouvé", "erreur interne du serveur", "erreur serveur", "page introuvable", "page non trouvée", "fichier introuvable", "est introuvable", "accès refusé", "accès interdit", "service indisponible", "désolé, une erreur est survenue", "une erreur est survenue", "une erreur s'est produite", "veuillez réessayer plus tard", "réessayez plus tard", "n'existe pas", "n'existe plus",
        "est indisponible", "est temporairement indisponible", "est actuellement indisponible", "n'est pas disponible", "n'est plus disponible", "n'a pas été trouvée", "n'a pas été trouvé", "a été supprimée", "a été déplacée", "en maintenance", "vous n'avez pas l'autorisation", "session a expiré", "ne peut pas être affichée", "délai d'attente dépassé",
    ],
    "es": [
        "error", "no se pudo establecer la conexión", "no se pudo conectar", "conexión perdida", "ha caducado", "ha expirado", "inicie sesión para", "servidor no responde", "no responde", "ha fallado", "falló", "no tienes permiso", "tareas de mantenimiento", "acceso restringido", "no se encuentra", "no encontrada", "no encontrado", "algo salió mal", "algo ha salido mal", "problemas técnicos", "no podemos encontrar", "no se puede acceder", "no se puede mostrar", "no hemos encontrado", "¡ups!", "error interno del servidor", "error del servidor", "página no encontrada", "archivo no encontrado", "no se ha encontrado", "no se encontró", "no se pudo encontrar", "no se pudo cargar", "acceso denegado", "acceso prohibido", "servicio no disponible", "lo sentimos, ha ocurrido un error", "ha ocurrido un error", "se ha producido un error", "se produjo un error",
        "vuelva a intentarlo más tarde", "inténtelo de nuevo más tarde", "inténtelo más tarde", "no existe", "ya no existe", "no está disponible", "ya no está disponible", "no está disponible temporalmente", "no está disponible en este momento", "en mantenimiento", "no tiene permiso", "sesión ha caducado", "tiempo de espera agotado",
    ],
    "it": [
        "errore", "impossibile connettersi", "connessione persa", "è scaduto", "è scaduta", "accedi per", "accesso limitato", "server non risponde", "non risponde", "non riuscita", "non riuscito", "qualcosa è andato storto", "andato storto", "problemi tecnici", "ops", "non è stata trovata", "non è raggiungibile", "impossibile trovare", "errore interno del server", "errore del server", "pagina non trovata", "file non trovato", "non trovata", "non trovato", "accesso negato", "accesso vietato", "servizio non disponibile", "servizio temporaneamente non disponibile", "si è verificato un errore", "riprova più tardi", "riprovare più tardi", "si prega di riprovare più tardi", "non esiste", "non esiste più",
        "non è disponibile", "non è più disponibile", "non è al momento disponibile", "temporaneamente non disponibile", "è stata rimossa", "è stata spostata", "in manutenzione", "non hai il permesso", "non hai i permessi", "sessione è scaduta", "impossibile caricare", "impossibile visualizzare", "non può essere visualizzata",
    ],
    "pt": [
        "erro", "não foi possível conectar", "conexão perdida", "link expirou", "expirou", "faça login para", "acesso restrito", "servidor não responde", "não responde", "falhou", "algo deu errado", "deu errado", "problemas técnicos", "ops", "não encontramos", "não pode ser encontrada", "não foi possível", "erro interno do servidor", "erro no servidor", "página não encontrada", "arquivo não encontrado", "não encontrada", "não foi encontrada", "não foi encontrado", "acesso negado", "acesso proibido", "serviço indisponível", "serviço temporariamente indisponível", "ocorreu um erro", "tente novamente mais tarde", "tente mais tarde", "não existe", "não existe mais",
        "não está disponível", "não está mais disponível", "está indisponível", "temporariamente indisponível", "foi removida", "foi movida", "em manutenção", "você não tem permissão", "sessão expirou", "não foi possível carregar", "não pode ser exibida",
    ],
    "ru": [
        "ошибка", "не удалось подключиться", "не удалось установить соединение", "соединение потеряно", "нет соединения", "ссылка устарела", "срок действия истек", "срок действия ссылки истек", "войдите, чтобы", "сервер не отвечает", "не отвечает", "ограничен", "ведутся технические работы", "технические работы", "что-то пошло не так", "пошло не так", "технические неполадки", "невозможно загрузить", "невозможно отобразить", "не можем найти", "не доступна", "не доступен", "ошибка сервера", "внутренняя ошибка сервера", "произошла ошибка", "возникла ошибка", "не найдена", "не найден", "не найдено", "страница не найдена", "файл не найден", "не существует", "больше не существует", "недоступен", "недоступна", "недоступно", "временно недоступен", "временно недоступна", "доступ запрещен", "доступ запрещён", "нет доступа", "попробуйте позже", "попробуйте еще раз", "повторите попытку позже",
        "технические работы", "была удалена", "была перемещена", "сессия истекла", "время ожидания истекло", "не удалось загрузить", "не удалось открыть",
    ],
    "zh": ["错误", "无法连接", "无法连接到服务器", "连接断开", "链接已过期", "已过期", "请登录", "访问受限", "服务器无响应", "无响应", "请稍后访问", "出现错误", "出现问题", "没有找到", "加载失败", "请求失败", "连接失败", "网络错误", "服务器错误", "服务器内部错误", "内部错误", "发生错误", "出错了", "未找到", "找不到", "页面未找到", "页面不存在", "不存在", "已被删除", "已被移动", "无法访问", "无法显示", "无法加载", "暂时不可用", "不可用", "拒绝访问", "访问被拒绝", "没有权限", "请稍后再试", "请稍后重试", "维护中", "系统维护", "会话已过期", "请求超时", "连接超时"],
    "ja": ["エラー", "接続できませんでした", "サーバーに接続できません", "接続が切れました", "期限が切れています", "有効期限が切れています", "ログインしてください", "応答がありません", "アクセスが制限されています", "表示できません", "しばらくお待ちください", "ただいまメンテナンス中です", "問題が発生しました", "失敗しました", "接続できません", "アクセスが集中", "サーバーエラー", "内部エラー", "エラーが発生しました", "見つかりません", "見つかりませんでした", "存在しません", "削除されました", "移動しました", "表示できません", "読み込めません", "読み込めませんでした", "アクセスできません", "アクセスが拒否されました", "利用できません", "権限がありません", "しばらくしてからもう一度お試しください", "もう一度お試しください", "後でもう一度お試しください", "メンテナンス中です", "メンテナンス中", "タイムアウト", "有効期限が切れました"],
    "nl": ["fout", "gaat niet", "niet gevonden worden", "interne serverfout", "serverfout", "pagina niet gevonden", "niet gevonden", "bestaat niet", "bestaat niet meer", "niet beschikbaar", "tijdelijk niet beschikbaar", "toegang geweigerd", "er is een fout opgetreden", "probeer het later opnieuw", "in onderhoud", "sessie is verlopen"],
    "pl": ["błąd", "strona nie istnieje", "błąd serwera", "wewnętrzny błąd serwera", "wystąpił błąd", "nie znaleziono strony", "nie znaleziono", "nie została znaleziona", "nie istnieje", "niedostępna", "niedostępny", "tymczasowo niedostępny", "odmowa dostępu", "brak dostępu", "spróbuj ponownie później", "przerwa techniczna", "sesja wygasła"],
}
ERROR_COMPOSED = {
    "de": (["ist", "sind"], ["derzeit", "zurzeit", "momentan", "vorübergehend", "leider", "aktuell", ""], ["nicht verfügbar", "nicht erreichbar", "nicht zugänglich", "nicht mehr verfügbar", "überlastet", "gesperrt"]),
    "fr": (["est", "sont"], ["actuellement", "temporairement", "momentanément"], ["indisponible", "inaccessible", "indisponibles", "inaccessibles"]),
}

FILLER_WHOLE = [
    "some placeholder text", "your title", "your heading", "your headline", "your name", "with your own text", "replace this paragraph", "more to come", "more coming soon", "check back soon", "stay tuned", "in kürze", "demnächst", "contenu à venir", "à venir", "bientôt disponible", "próximamente", "contenido próximamente", "contenuto in arrivo", "in arrivo", "prossimamente", "em breve", "conteúdo em breve", "скоро здесь появится текст", "скоро здесь появится", "скоро будет", "即将推出", "内容即将推出", "敬请期待", "近日公開", "coming soon to this page", "wkrótce", "binnenkort",
    "placeholder for", "placeholder", "sample heading", "example heading", "sample title", "title of the section", "to follow", "beschreibung folgt", "text folgt", "inhalt folgt", "texte d'exemple", "à remplacer", "texto de prueba", "reemplazar antes de publicar", "testo di prova", "da sostituire", "testo da inserire", "substituir antes de publicar", "текст будет добавлен позже", "будет добавлен позже", "заполнить позже", "待补充", "待填写", "後で追加", "準備中",
    "lorem ipsum", "dummy content", "sample content", "replace with your own", "replace me", "tbd", "to be added", "to be written", "to be completed", "text to be added", "description to follow", "under construction",
    "this is dummy text", "dummy text", "write your own introduction here", "text text text", "your paragraph goes here", "replace it before publishing", "replace this text", "placeholder paragraph: describe the data set in two or three sentences", "placeholder paragraph", "placeholder text", "section title", "untitled section", "untitled", "double click to edit this cell",
    "double-click to edit", "double click to edit", "click to edit", "click to edit it", "click here to add text", "click here to edit", "type something here", "content coming soon", "coming soon", "this is sample text", "this is placeholder text", "this is a placeholder", "edit or remove this text inline", "add some text here to explain this section",
    "texte provisoire à remplacer par votre introduction", "texte provisoire", "texte à remplacer", "texto de relleno, sustituir por la introducción", "texto de relleno", "texto de ejemplo", "hier steht später der einleitungstext", "bitte ersetzen", "platzhaltertext", "platzhalter", "blindtext", "testo segnaposto", "testo di esempio", "texto de exemplo", "текст-заполнитель", "пример текста", "占位文本", "示例文本", "ダミーテキスト", "サンプルテキスト",
]
FILLER_COMPOSED = {
    "goes": (["text", "your text", "sample text", "heading", "title", "your title", "body copy", "body text", "content", "your content", "description", "your description", "subtitle", "caption", "name", "your name", "author name", "project name", "your abstract", "your summary", "your notes", "image"], ["goes here", "here", "comes here", "will go here"], " "),
    "put": (["insert", "add", "enter", "write", "type", "paste", "put"], ["your", "some", "a", "a short", "your own", "the", ""], ["text", "body text", "content", "title", "heading", "description", "description of your project", "introduction", "intro", "summary", "abstract", "notes", "note", "name", "caption", "conclusion", "paragraph", "story", "answer", "code", "comment", "message", "question"], ["here", "in here", "below"], " "),
    "de": (["hier", "hier bitte"], ["steht", "kommt", "folgt", "entsteht"], ["ihr text", "ihr text hin", "der text", "der text hin", "dein text", "ihr inhalt", "der inhalt"], " "),
    "de add": (["fügen sie hier", "geben sie hier", "schreiben sie hier", "hier"], ["ihren text", "den text", "einen text", "ihre beschreibung", "ihre einleitung", "ihre zusammenfassung", "ihren titel", "ihre notizen", "ihren namen", "text"], ["ein", "hinein", "einfügen", "eingeben", ""], " "),
    "fr": (["insérez", "ajoutez", "saisissez", "écrivez", "tapez", "décrivez", ""], ["votre texte", "un texte", "votre contenu", "votre titre", "votre projet", "votre introduction", "votre résumé", "votre nom", "une description"], ["ici"], " "),
    "es": (["escriba", "inserte", "introduzca", "añada", "agregue", ""], ["su texto", "tu texto", "su contenido", "el texto", "un título", "su nombre", "su introducción", "un resumen"], ["aquí"], " "),
    "it": (["inserisci", "inserire", "scrivi", "aggiungi"], ["qui il tuo testo", "qui il testo", "il tuo testo qui", "il testo qui", "qui un titolo", "qui una descrizione", "qui il tuo nome", "qui la tua introduzione"], " "),
    "pt": (["insira", "digite", "escreva", "adicione", ""], ["seu texto", "o seu texto", "o texto", "seu conteúdo", "seu nome", "sua introdução", "uma descrição"], ["aqui"], " "),
    "ru": (["введите", "вставьте", "добавьте", "напишите"], ["текст", "ваш текст", "свой текст", "описание", "заголовок"], ["здесь", "сюда"], " "),
    "zh": (["在此", "请在此", "在这里", "请在这里", "此处", "在此处"], ["输入", "添加", "插入", "填写"], ["文字", "文本", "内容", "标题", "说明", "描述", "您的文字"], ""),
    "ja": (["ここに", "こちらに"], ["テキスト", "文章", "内容", "タイトル", "説明"], ["を入力してください", "を入力", "を記入してください", "が入ります"], ""),
    "nl": (["voer hier", "voeg hier", "typ hier"], ["uw tekst", "je tekst", "tekst"], ["in", "toe", ""], " "),
    "pl": (["wpisz", "wstaw", "dodaj"], ["tutaj", "tu"], ["tekst", "swój tekst", "treść"], " "),
}

LOOSE_WHOLE = [
    # English
    "web browser", "in your web browser", "browser", "the comments", "powered by", "improve your experience", "your experience", "in order to", "outdated", "either", "or", "oh no", "hmm", "whoops", "that", "to this page", "this repository", "you requested", "no longer", "not", "in your region", "your country", "we couldn't", "we're", "my", "an", "please", "sorry", "your browser", "the browser", "browser settings", "your browser settings", "in the settings", "and refresh the page", "and reload the page", "and reload", "and try again", "then reload", "for full functionality", "to work properly", "to work", "to run", "to use", "to view", "to see", "to display", "to access", "to continue", "to proceed", "it is necessary", "you need to", "you must", "you have to",
    "you need", "looks like", "it looks like", "this feature", "this application", "this app", "this site", "this website", "this page", "this map", "this content", "this resource", "this server", "on this server", "the page", "the site", "the server", "the resource", "the file", "you are looking for", "you were looking for", "you requested", "you have requested", "your request", "right now", "at the moment", "at this time", "but", "and", "or", "was", "were",
    "is", "are", "be", "has", "have", "been", "it", "we", "you", "the", "this", "that", "of", "with", "due to", "our team", "notified", "has been notified", "have been notified", "later", "again", "temporarily", "currently", "the service", "connection", "session", "wait while", "please wait", "click", "edit", "to", "for", "on", "in", "your", "a", "an",
    # German
    "funktioniert", "die webseite", "webseite", "momentan", "derzeit", "fortzufahren", "nur", "diese", "wegen", "entschuldigung", "es tut uns leid", "später", "erneut", "bitte", "diese seite", "die seite", "diese anwendung", "diese website", "der dienst", "der server", "ihr browser", "in ihrem browser", "um", "zu können", "nutzen", "sehen", "ein", "von ihnen gesuchte", "angeforderte", "die angeforderte seite", "aufzurufen", "für", "konnte", "kann", "die", "der", "das", "ist", "sie", "es", "um diesen inhalt anzuzeigen", "leider",
    # French
    "nous", "actuellement", "accéder à", "utiliser", "afficher", "dans", "des", "malheureusement", "plus tard", "que vous cherchez", "vous", "ce site", "cette page", "cette application", "la page", "le service", "le serveur", "votre navigateur", "dans votre navigateur", "pour continuer", "pour afficher", "pour utiliser", "vous devez", "que vous recherchez", "demandée", "désolé", "veuillez", "merci", "le", "la", "les", "ce", "de", "pour", "est", "temporairement",
    # Spanish
    "que buscas", "contenido", "este contenido", "ver", "usar", "la", "más tarde", "no", "temporalmente", "este sitio", "esta página", "esta aplicación", "la página", "el servicio", "el servidor", "su navegador", "en su navegador", "para continuar", "para usar", "para ver", "debe", "que busca", "que está buscando", "solicitada", "lo sentimos", "por favor", "temporalmente", "el", "en", "su", "para",
    # Italian
    "utilizzare", "visualizzare", "che cerchi", "la", "più tardi", "ci dispiace", "siamo spiacenti", "al momento", "questo sito", "questa pagina", "questa applicazione", "la pagina", "il servizio", "il server", "il tuo browser", "nel tuo browser", "per continuare", "per visualizzare", "per utilizzare", "è necessario", "richiesta", "che stai cercando", "per favore", "spiacenti", "si prega di", "il", "di", "per", "un",
    # Portuguese
    "acessar", "para acessar", "este conteúdo", "procurada", "a", "mais tarde", "no momento", "este site", "esta página", "este aplicativo", "a página", "o serviço", "o servidor", "seu navegador", "no seu navegador", "para continuar", "para ver", "para usar", "é necessário", "que você procura", "solicitada", "por favor", "desculpe", "o", "que", "você",
    # Russian
    "эту страницу", "просмотреть", "чтобы", "которую вы ищете", "приложения", "работы", "этого", "сейчас", "позже", "нужно", "браузер", "браузере", "сайта", "для работы сайта", "для просмотра", "этот сайт", "эта страница", "страница", "сервис", "сервер", "сайт", "ваш браузер", "в вашем браузере", "в браузере", "чтобы продолжить", "необходимо", "пожалуйста", "запрошенная", "извините", "к сожалению", "в", "для",
    # Chinese and Japanese
    "您需要", "您", "需要", "运行", "此应用", "应用", "很抱歉", "稍后", "再试", "再", "稍后再试", "内容", "查看", "申し訳ありませんが", "お探しのページ", "アプリ", "この", "後で", "もう一度", "请", "以继续", "您的浏览器", "浏览器", "本页面", "此页面", "该页面", "页面", "您访问的", "访问的", "抱歉", "才能", "正常显示", "正常", "显示", "的", "服务器", "继续", "本网站", "此网站", "网站", "以", "在",
    "このサイト", "このページ", "ページ", "サイト", "表示する", "には", "お使いの", "ブラウザ", "は", "が", "を", "の", "申し訳ありません", "申し訳ございません", "お探しの", "サーバー", "ください", "続行する", "利用する",
    # Dutch and Polish
    "deze website", "deze pagina", "uw browser", "om verder te gaan", "de pagina", "de dienst", "ta strona", "strona", "serwis", "przeglądarka", "twoja przeglądarka", "aby kontynuować", "proszę",
]

#: Words that notices are made of besides what makes them notices, by language. Words of any subject matter are left out on purpose.
LOOSE_WORDS = {
    "en": "allow hour hours interactive output hidden discussion sent lost received reply database notebook a about above access account active add address administrator after again all allow allowed an and another any anything app appears application are as ask at available back be because been before being below blocked blocks broken browse browser but by came can cannot caused change check chrome clear click close come connect connection contact content continue cookies could "
    "couldn't currently detected did didn't directory disabled display displayed do document does doesn't don't due edge either enable enabled end enough error errors ever execution existing expired extension f5 failed feature few file find firefox fixed follow followed for form found from full gateway get go going had happened happens has have help here hit home homepage host how http https if in instead internet into is "
    "isn't issue issues it its javascript just later limit link load loaded loading log login longer look looking made maintenance make may message might minute minutes missing moment more most moved must my need needed needs network new no not nothing now occurred of off offline often on one only open or origin our out outage over page pages panel past permission please possible press prevent preview problem problems process proceed "
    "properly protected provider proxy quick reach reached reason refresh reload removed render reported request requested requests require required requires resource respond responding response restart retry return running safari script scripts search seconds secure security seem seems send server service session set settings should shortly sign site slow some something soon start status still stop such supported support supports sure switch temporarily than thank "
    "thanks that the their them then there these they thing this those time timed tls to too try trying turn turned two type unable under unexpected unsupported until up update upstream url use used user using valid version via view viewer visit wait was we we'll we're we've web webpage website well went were what when where which while who why will window with without won't work working works wrong you you'll you're you've your yourself",
    "de": "browsers leere verbindung melden anmelden antwort anfrage aber alle an auf aus bei bitte browser da damit das dass dem den der derzeit des die dies diese diesem diesen dieser dieses ein eine einem einen einer einige entfernt er erlauben erneut es etwas fehler fortfahren funktioniert für gerade gesuchte gibt haben hat hier ich ihr ihre ihrem ihren im in ist jetzt kann kein keine können laden leider link man mehr mit müssen nach nicht noch nochmals nun nur oder ohne prüfen sehen sein seite seiten server sich sie sind so später suchen "
    "um und uns unsere unter versuchen verwenden vom von vorhanden war webseite website weiter wenden wenn werden wieder wir wird wurde wurden zu zum zur zurück zugriff einstellungen inhalt inhalte anzeigen angezeigt aufrufen adresse minuten moment unerwarteter skript skripte blockiert neu",
    "fr": "profiter demandé connecter lien reçu réponse à a accès accueil actuellement adresse afficher ainsi alors application au aucun autorisé aux avec avez avons bien car ce ces cet cette chargement cliquez comme connexion consulter contenu dans de demande demandée des désactivé désolé deux doit du elle en erreur est et être fonctionne fonctionner ici il internet je l'accès l'adresse la le les leur lien ma mais maintenance merci minutes moment navigateur ne non nos notre nous on ou où page pages par paramètres pas peut plus "
    "pour pouvez problème quelques qui que réessayer requête retour sa sans se serveur service site sont soit sur temps tard un une utiliser utilisez vers veuillez votre vos vous êtes n'est n'êtes d'accueil l'auteur recherchez",
    "es": "mostrar conectar respuesta a acceder acceso actualmente al algo antes aplicación aquí ayuda cargar como con conexión contenido correctamente de debe del desde después dirección disculpe e el ella en enlace es esta está este esto estamos funciona funcionar ha haber hay inicio intente internet la las le lo los mantenimiento más minutos momento mostrar mucho navegador necesita necesitas no nos nuestra nuestro o página páginas para pero permiso por problema puede que realizando recargue "
    "se ser servicio servidor si siguiente sin sitio sobre son su sus tareas tarde tiene tienes todo tu un una unos usar utilizar ver vez volver vuelva web y ya antes actualice",
    "it": "a accedere accesso adesso ai al alla anche applicazione browser che ci come con connessione contenuto corretta da dal dei del della di disattivato attivalo e è essere funziona funzionare ha hai home i il in indirizzo internet l'accesso l'applicazione la le lo ma manutenzione minuti momento nei nel nella non o ora pagina pagine per permesso più poi possibile presto problema prova proseguire può qualche questa questo quindi ricarica ricaricare richiesta se servizio server "
    "si sito sono su torneremo tra troppo tuo un una uno usa utilizza vedere visualizzare web",
    "pt": "a acessar acesso agora ainda alguns antes ao aplicativo aplicação aqui as até atualize com como conexão conteúdo da das de depois desculpe deste do dos e é ela em endereço está este esta foi funciona funcionar há início internet isso já link mais manutenção mas minutos momento na não nas navegador necessário no nos o ou os página páginas para pela pelo permissão pode por precisa problema que recarregue se sem ser serviço servidor site sobre sua suas tarde tem tente um uma usar ver você volte voltar",
    "ru": "а адрес без браузер браузера браузере был была были быть в вам вас ваш ваша вашем ваши вернуться вернитесь ведутся во возможно вы для до доступ если еще ещё за зайти запрос и из или интернет к как которую который ли мы на наш нашли не нет но ничего о об обновите обратитесь ограничен он она от ошибка перейдите перезагрузите по позднее позже пожалуйста попробуйте после при продолжить проверьте просмотра работа работы работает раз ресурс ресурсу с сайт сайта сайте "
    "сейчас сервер сервера сервис скоро снова со страница страницу страницы так то только у уже устарела через что чтобы эта эти это этой эту этот настройках",
    "nl": "aan alstublieft bekijken browser dan dat de deze die dit doen door een en er gebruiken het hier in is je kan kunnen later link meer met naar niet nog nu of om onze op opnieuw over pagina probeer server site te tijdelijk toegang u uit uw van verder voor want weer website werkt wordt zoekt zijn",
    "pl": "aby adres bez być chwilę czy dla do dostęp i inną jest jeszcze kontynuować lub na nie niestety obecnie od oraz ponownie później proszę przeglądarce przeglądarka przeglądarki przepraszamy przez się serwer serwis spróbuj strona stronę strony ta tej ten to tym użyć w witryna z za zostać została",
}


def _joined(*lists_and_separator) -> list[str]:
    *lists, separator = lists_and_separator
    return [separator.join(filter(None, parts)) for parts in product(*lists)]


def phrases() -> dict[str, int]:
    """Every phrase with the kinds it belongs to."""
    kinds: dict[str, int] = {}

    def add(kind: int, *groups: list[str]) -> None:
        for group in groups:
            for phrase in group:
                kinds[phrase] = kinds.get(phrase, 0) | kind

    for language, frames in SCRIPT_FRAMES.items():
        add(SCRIPT, [f.format(n) for f in frames for n in NAMES.get(language, NAMES[""])])
    add(SCRIPT, _joined(NAMES["en"], SCRIPT_BE, SCRIPT_STATES, " "), [f.format(n) for f in SCRIPT_WHOLE for n in NAMES["en"]], SCRIPT_LOOSE)
    add(ERROR, ERROR_FRAMES, _joined(ERROR_NOT, ERROR_STATES, " "), _joined(ERROR_HOW, ERROR_BAD, " "), *ERROR_WHOLE.values(), *(_joined(*lists, " ") for lists in ERROR_COMPOSED.values()))
    add(FILLER, FILLER_WHOLE, *(_joined(*lists) for lists in FILLER_COMPOSED.values()))
    add(SHOWN, ERROR_SUBJECTS)
    add(LOOSE, LOOSE_WHOLE, *(words.split() for words in LOOSE_WORDS.values()))
    return kinds
