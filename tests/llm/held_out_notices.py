"""Notices as they stand on web pages of many kinds, in eleven languages, and real text about the same things. None is in a test table.

``NOTICES`` were written before the phrases were composed and not used to compose them, but by the same hands; what they have in common with the phrases
is no accident. ``FRESH`` were written last of all, and no phrase was changed since.
"""

# Script notices, error pages and filler, then real text about the same things.
NOTICES = [
    "JavaScript must be turned on to view this website.", "Your browser does not support JavaScript!", "This application requires JavaScript to run.", "Sorry, you need JavaScript enabled to use this app.",
    "We're sorry but this site doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is not enabled. Please enable JavaScript in your browser settings and refresh the page.", "You need to have JavaScript enabled to see this map.",
    "This feature requires scripts to be enabled.", "Scripts are blocked. Allow scripts and reload the page.", "Looks like JavaScript is disabled in your browser.", "Turn on JavaScript and cookies to continue.", "Enable JavaScript and cookies to continue", "Please turn JavaScript on and reload the page.",
    "JavaScript appears to be disabled in your browser.", "For full functionality of this site it is necessary to enable JavaScript.", "Please wait while we check your browser.", "Checking if the site connection is secure", "Without JavaScript this page cannot be displayed.",
    "Für diese Seite wird JavaScript benötigt.", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Diese Anwendung benötigt JavaScript.", "Ihr Browser unterstützt kein JavaScript.", "JavaScript muss aktiviert sein, um diese Seite zu sehen.", "Um diese Seite nutzen zu können, aktivieren Sie bitte JavaScript.",
    "Ce site nécessite JavaScript.", "Vous devez activer JavaScript pour utiliser ce site.", "Votre navigateur ne prend pas en charge JavaScript.", "Merci d'activer JavaScript pour continuer.", "JavaScript est nécessaire pour afficher cette page.",
    "Este sitio requiere JavaScript.", "Su navegador no soporta JavaScript.", "Debe habilitar JavaScript para usar esta aplicación.", "JavaScript está deshabilitado en su navegador.", "Active JavaScript en su navegador para continuar.",
    "Questo sito richiede JavaScript.", "Abilita JavaScript per continuare.", "È necessario attivare JavaScript per visualizzare questa pagina.", "Il tuo browser non supporta JavaScript.", "Este site requer JavaScript.", "Ative o JavaScript para continuar.", "Seu navegador não suporta JavaScript.",
    "É necessário habilitar o JavaScript para ver esta página.", "Для работы сайта необходимо включить JavaScript.", "Пожалуйста, включите JavaScript в вашем браузере.", "Ваш браузер не поддерживает JavaScript.", "请启用JavaScript以继续。", "您的浏览器不支持JavaScript。", "本页面需要启用JavaScript才能正常显示。",
    "このサイトを表示するにはJavaScriptを有効にしてください。", "JavaScriptが無効になっています。", "お使いのブラウザはJavaScriptに対応していません。", "Deze website vereist JavaScript.", "Schakel JavaScript in om verder te gaan.", "Ta strona wymaga włączonej obsługi JavaScript.",
    "This site can't be reached", "404 - File or directory not found.", "The page you are looking for doesn't exist or has been moved.", "The page you were looking for could not be found.", "500 - Internal server error. There is a problem with the resource you are looking for, and it cannot be displayed.",
    "Sorry, this content isn't available right now.", "The server encountered an internal error and was unable to complete your request.", "The requested URL was not found on this server.", "You don't have permission to access this resource.", "Your request could not be processed. Please try again.",
    "This video is unavailable.", "This account has been suspended.", "We'll be back soon! The site is currently undergoing scheduled maintenance.", "The connection has timed out.", "Secure connection failed", "The service is temporarily overloaded. Please try again later.",
    "Your session has timed out. Please sign in again.", "Error establishing a database connection", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "An unexpected error has occurred. Our team has been notified.",
    "404 - Seite konnte nicht gefunden werden", "Die von Ihnen gesuchte Seite existiert nicht.", "Der Dienst ist vorübergehend nicht verfügbar.", "Interner Serverfehler", "Der Server ist derzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "Sie haben keine Berechtigung, diese Seite aufzurufen.",
    "La page que vous recherchez n'existe pas.", "Erreur interne du serveur", "Le service est temporairement indisponible.", "Cette page n'est pas disponible.", "La página que busca no existe.", "Error interno del servidor", "El servicio no está disponible temporalmente.", "Esta página no está disponible.",
    "Pagina non trovata", "La pagina richiesta non esiste.", "Si è verificato un errore. Riprova più tardi.", "Servizio temporaneamente non disponibile", "Página não encontrada", "A página que você procura não existe.", "Ocorreu um erro. Tente novamente mais tarde.", "Serviço temporariamente indisponível",
    "Страница не найдена", "Произошла ошибка. Попробуйте позже.", "Сервис временно недоступен.", "页面未找到", "服务器内部错误", "抱歉，您访问的页面不存在。", "ページが見つかりません", "サーバーエラーが発生しました。", "Pagina niet gevonden", "Strona nie została znaleziona",
    "Dear [FIRST NAME], thank you for choosing [COMPANY].", "Hello {{first_name}}, your order {{order_id}} is on its way.", "[Company Name] was founded in [Year] by [Founder].", "Posted by [AUTHOR] on [DATE]", "Insert your text here.", "Add a short description of your project here.",
    "Click here to add text", "Your content goes here. Edit or remove this text inline.", "This is sample text. Click to edit it.", "Text goes here", "Fügen Sie hier Ihren Text ein.", "Hier kommt Ihr Text hin.", "Votre texte ici", "Ajoutez votre texte ici.", "Su texto aquí", "Inserisci qui il tuo testo",
    "Insira seu texto aqui", "Введите текст здесь", "在此输入文字", "ここにテキストを入力してください",
]
TEXTS = [
    "We load the data with JavaScript and draw the chart in the browser.", "JavaScript must be turned on for the widget, which is why we also export a static image of every figure.", "The crawler saw 404 for about 3 percent of the links, most of them on two hosts.",
    "The server returned an error for every request above 10 MB, so the upload is done in parts of 5 MB and retried with a growing delay.", "In this section we compare three models on the same split.", "Error bars show one standard deviation over five seeds.", "The page rank of every node is computed with a damping factor of 0.85.",
    "A request that was not found in the cache is sent to the backend.", "Sensors that are not available at night were dropped from the table.", "This function requires a script that installs the fonts.", "Die Seite wurde am Montag neu gesetzt, und der Dienst lief danach wieder stabil.", "Le service a traité 1200 demandes par heure en moyenne.",
    "El error medio es de 0,12 y no depende de la temporada.", "La pagina contiene tre tabelle con i risultati per regione.", "O erro médio caiu pela metade depois da correção.", "Ошибка модели уменьшается с ростом выборки.", "该页面列出了所有实验的结果。", "このページでは実験の結果をまとめます。",
    "The session [42] in the log belongs to the first participant.", "See [the documentation](https://docs.example) for the list of options.", "Values in df[name] are replaced by their rank.", "The field [date] of the table is parsed with a fixed format, then the rows are grouped by week.", "Please try the second notebook later if you want to see how the score changes.",
    "Maintenance of the pumps is scheduled by the model every six weeks.", "We enabled the plugin to continue the experiment with a larger batch.", "Not found: 12 of the 340 species.", "Warning: the axis is logarithmic.", "To continue, run the next cell; it takes about two minutes on a laptop.",
]
FRESH = ["JavaScript needs to be activated for this gallery.","You will need JavaScript to play this game.","Widgets need JavaScript. Please switch it on in your browser.","To see the plot, enable scripts.","Your browser is blocking scripts from this site.","Dieses Widget braucht JavaScript.","Activez les scripts pour voir la carte.","Esta galería necesita JavaScript.","Attiva gli script per continuare.","O mapa precisa de JavaScript.","Включите JavaScript для просмотра карты.","查看此图表需要JavaScript。","地図を見るにはJavaScriptが必要です。",
    "The gateway did not receive a response in time.","We are experiencing technical difficulties. Please try again later.","This post has been deleted by its author.","Server is busy, please wait.","You must be logged in to see this.","File not found or access denied.","The download link is no longer valid.","Die Datei wurde gelöscht.","Der Server ist überlastet, bitte warten.","Ce fichier a été supprimé.","Ese archivo ha sido eliminado.","Il file è stato eliminato.","O arquivo foi excluído.","Файл удалён.","文件已被删除。","このファイルは削除されました。",
    "Write something about yourself here.","Project description goes here.","[Your Company]","Hi {{name}}, thanks for signing up to {{product}}.","Section heading placeholder","Enter your text here...","Hier bitte Text einfügen","Insérez votre titre ici","Escriba aquí su texto","Scrivi qui il tuo testo","Texto aqui"]
