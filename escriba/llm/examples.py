"""Labelled examples from which problem 8's model learns: messages by kind, and genuine text that speaks of such things."""

from __future__ import annotations

MESSAGES: dict[str, list[str]] = {
    "error": """
404 Not Found
Error 404: Not Found
HTTP 404 page not found
status=403 Forbidden
403 Forbidden
Error 403 access denied
Estado 403: acceso denegado
Erro 403: acesso negado
Error 403: accés denegat
502 Bad Gateway
HTTP 502 Bad Gateway
504 Gateway Timeout
Error 504 gateway timeout
503 Service Unavailable
HTTP 503 Service Unavailable
Service temporarily unavailable
The service is unavailable, try again later
500 Internal Server Error
Error 500: Internal Server Error
The server encountered an internal error
429 Too Many Requests
Too many requests. You have been rate limited
You have been rate limited (429).
You do not have permission to access this page
Permission denied
Request timed out
The request timed out, please reload
Connection refused
The connection has timed out
Your session has expired. Please log in again
Session expired, sign in again
Su sesión ha caducado. Identifíquese de nuevo
Su sesión ha expirado
A sua sessão expirou. Entre de novo
La seva sessió ha caducat
Error 404: página no encontrada
Página no encontrada
Estado 404: la página solicitada no existe
Erro 404: a página solicitada não existe
Página não encontrada
Pàgina no trobada
Estado 404: la pàgina sol·licitada no existeix
Error 404: la pàgina sol·licitada no existeix
HTTP 503 recurso no disponible temporalmente
Estado 503: recurso no disponible
Servicio no disponible
Error 504: el servidor tardó demasiado en responder
Estado 504: el servidor tardó demasiado en responder
Error interno del servidor
Erro interno do servidor
Error intern del servidor
Vuelva a intentarlo más tarde
Inténtelo de nuevo en unos minutos
Tente novamente dentro de minutos
Torneu a provar més tard
Try again later
Please try again in a few minutes
Please contact the administrator
Contact the site administrator
Contacte con el administrador
Regrese al inicio
Back to home page
Request ID: 4f2a91
Request ID 77ab12
request id 0
Código de error: 1020
Error code 1020
Código de erro 500
The facsimile server is down for maintenance
The site is down for maintenance
Sitio en mantenimiento
Estamos realizando tareas de mantenimiento
No se ha podido cargar el visor de facsímiles
No se ha podido cargar la página
No se pudo cargar la imagen
No se pudo conectar con la base de datos
SQLSTATE[HY000] no se pudo conectar con la base de datos
SQLSTATE[42S02] base table not found
Could not connect to the database
Error establishing a database connection
Failed to load resource
Failed to load the image viewer
Checking your browser before opening the page
Checking your browser before accessing the site
Verifying that you are human
Traceback (most recent call last):
Traceback (most recent call last): File "app.py", line 12, in render_page KeyError: 'folio'
File "page.py", line 3, in render_page
KeyError: 'folio'
TypeError: 'NoneType' object is not subscriptable
ValueError: invalid literal
stack trace
Unhandled exception at line 20
Exception in thread main
java.lang.NullPointerException at Viewer.load(Viewer.java:120)
java.lang.NullPointerException at ViewerServlet.load(ViewerServlet.java:77)
at org.apache.catalina.core.StandardWrapper.invoke(StandardWrapper.java:90)
Null pointer exception
Warning: Undefined variable $regesto in ficha.php on line 7
Warning: Undefined variable $texto in pagina.php on line 12
Notice: Undefined index: doc in index.php on line 3
Warning: Division by zero in list.php on line 5
Fatal error: call to undefined function in index.php on line 9
Parse error: syntax error, unexpected token on line 4
[object Object] undefined undefined NaN
[object Object]
undefined undefined undefined
undefined null NaN
Segmentation fault (core dumped)
""".strip().split("\n"),
    "notice": """
You need to have scripting turned on to display the folio viewer
You need to enable JavaScript to run this app
You need to enable scripts to view this page
Please enable JavaScript in your browser
Please turn on JavaScript and reload
JavaScript is disabled. Please enable it and reload
JavaScript is disabled in your browser
JavaScript is required to view this page
This viewer requires JavaScript
This site requires JavaScript
This page needs JavaScript
Your browser does not support scripts
Your browser does not support JavaScript
Su navegador no admite scripts o los tiene desactivados; el texto no puede mostrarse
Su navegador no admite JavaScript
Su navegador no soporta scripts
JavaScript está desactivado
JavaScript desactivado en su navegador
Para ver esta transcripción active JavaScript en su navegador
Para ver esta transcripción habilite JavaScript en su navegador
Para ver esta transcripción permita JavaScript en su navegador
Active JavaScript para ver la página
Habilite JavaScript en su navegador
Este sitio necesita guiones activos. Permita la opción
Este sitio necesita guiones activos: active la opción
Este sitio necesita guiones activos: habilite la opción
Este sitio requiere JavaScript
Esta página necesita JavaScript
Ative o JavaScript para ver o documento
O seu navegador não suporta JavaScript
Este sítio requer JavaScript
Si us plau, activeu JavaScript per veure el document
El vostre navegador no admet JavaScript
Cal activar JavaScript per veure la pàgina
Enable cookies to continue to the catalogue
Accept cookies to continue to the catalogue
Allow cookies to continue to the catalogue
Please accept cookies to continue
Accept all cookies
We use cookies to improve your experience
This site uses cookies
This website uses cookies
Este sitio usa cookies
Este sitio utiliza cookies. Acepte para continuar
Acepte las cookies para continuar
Este site utiliza cookies
Aceite os cookies para continuar
Accepteu les galetes per continuar
Cookies must be enabled to continue
""".strip().split("\n"),
    "filler": """
Lorem ipsum dolor sit amet
Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
Dolor ipsum incididunt sed adipiscing labore lorem eiusmod magna et aliqua ut elit sit dolore
tempor lorem sed labore et adipiscing ut ipsum eiusmod dolor amet
elit do incididunt consectetur sit magna dolore aliqua
ipsum sit amet aliqua adipiscing labore lorem elit do
do sed magna ipsum dolor do consectetur elit incididunt eiusmod adipiscing
aliqua tempor incididunt eiusmod
consectetur amet lorem
adipiscing aliqua lorem ipsum
Sample paragraph
Sample paragraph. Replace with the real description
Sample text
Replace with description
Placeholder text
Dummy text goes here
Your text here
Insert your text here
Text goes here
Texto de ejemplo
Texto de prueba
Texto de relleno
Texto de muestra
Párrafo de relleno
Párrafo de ejemplo
Contenido de prueba. Borrar antes de publicar
Contenido de prueba
Contenido de ejemplo
Contenido de relleno
Borrar antes de publicar
Aquí va el texto de la transcripción
Aquí va el texto
Inserte aquí el texto
Texto de exemplo
Text d'exemple
TBD TBD TBD
TBD TBD
asdf asdf qwer asdf zxcv
asdf qwer zxcv asdf
qwerty qwerty asdf
asdf asdf
qwer zxcv
xxxx xxxxx xxx xxxxxx
xxx xxx xxx
aaaa aaaa aaaa
foo bar baz
""".strip().split("\n"),
}

GENUINE: list[str] = """
La página 12 del libro no fue encontrada en el archivo, según la nota del copista
la página solicitada por el escriuano no estaua en el libro
el folio no fue encontrado en el archivo
the page was not found in the archive when the catalogue was made
not found in the second quire
El error del escriuano en el folio 12 se corrigió al margen
el copista corrigió el error en la línea 3
the scribe's error on line 4 was corrected in the margin
error del copista
the error of the notary on folio 22
Falta el servidor de la capilla, que no está disponible en 1540
el servidor del rey que fue criado de su casa
servidor de vuestra merced
the server of the altar was absent
El acceso al legajo estuvo denegado hasta el año de 1612
acceso al archivo por la puerta
access to the bundle was denied until the year 1700
fue denegado por el alcalde
entry was forbidden to strangers
it is forbidden to sell the vineyard
The scribe's script is enabled by wide ruling; cookies of wax remain on folio 12
script of the notary in brown ink
the script is a cramped cortesana
letra y script del notario
Falta texto por rotura del papel y sigue ilegible
falta el texto de la carta
texto ilegible por mancha
el texto de la transcripción sigue al folio 3
texto de la carta de venta
contenido de la carta
contenido del legajo
párrafo segundo de la carta
muestra de la letra
prueba de testigos
la prueba de los testigos que fueron presentes
ejemplo de letra procesal
dolor y muerte, ipsum corpus in terra positum
dolor et labor magna sit in terra
sit nomen domini benedictum
magna carta et sigillum
et ipsum sigillum apposuit
quod ipsum dedit in dolore
ut dictum est sed non scriptum
elit et dedit
tempore quo domus fuit
sed et ipsum et magna terra
do y otorgo todo mi poder cumplido a vos
do et vendo
do moinho e da vinha do mosteiro
no disponible
no está disponible
el recurso que presentó ante el alcalde
recurso de apelación ante la chancillería
la sesión del concejo de mayo
session of the council
en unos minutos de la carta
inicio del cuaderno
al inicio de la página
el administrador de la hacienda
contact with water has damaged the folio
request of the abbot
a request for the seal
the viewer of the markets
vea el estado de la causa
el estado eclesiástico
en el estado que está el pleito
código de leyes de 1567
line 12 of the folio
on line 4 the hand changes
a later hand on line 7
el navegador y piloto Juan de la Cosa
la base de la columna
mantenimiento de la puente
el mantenimiento de su casa
la opción de compra de la viña
permita dios que
que permita el alcalde
active y passiue
xxx maravedís
iii dias de mayo
xxx iii fanegas
ccc maravedís e iii sueldos
this site was a monastery
the page is torn and the text is lost
reload
sample of ink
sample of parchment taken from the binding
the text of the deed
description of the seal
the catalogue of the archive
to continue to the next folio
sign of the notary
sesenta y dos
publicar y pregonar
antes de publicar la sentencia
mandó publicar la carta
""".strip().split("\n")
