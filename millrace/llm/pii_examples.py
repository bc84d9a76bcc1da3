"""The labelled table of the tagger for personal information.

The rows were written for this table, as lines that programs and people write in several languages, and not taken from any table the tagger is used on. Each is a line with
its personal information marked as {kind}; {kind} stands for one of the forms below, filled in by rule, so that the tagger learns the shape and the
place of a kind and no single value. Small braces mark fillings that are no personal information. Forms: 9 is a digit, A a capital, [..] encloses the part that counts.
Every third row and every third form of a kind are left out where the tagger is judged (`held_out`): it is judged by forms of lines and values it hasn't seen.
"""

from __future__ import annotations

# Rows labelled by hand.
LINES = r"""
Interview with {name} moved to room {n}
Signed off by {name} at {hms}
Reviewer {name} approved change {hex}
{name} has joined the call, {n} guests waiting
Dear {name}, your order {num} is on its way.
Visitor badge {n} issued to {name}
caller {name} on hold for {dec} s
contact={name} mail={email} phone={phone}
beneficiary {name}, policy {num} closed
{name};{phone};{email}
{name} | {addr} | {phone}
{num},{name},{id},{phone}
id={n} fullname="{name}" street="{addr}"
Letter from {name} scanned, {n} pages
Kontakt: {name}, Tel. {phone}
Kundin {name} hat den Vertrag {num} gekündigt
Lieferung an {name}, {addr}, abgeschlossen
Rendez-vous avec {name} confirmé pour {hms}
Le client {name} est joignable au {phone}
Cita con {name} en {addr}
Llamar a {name} al {phone} antes de {hms}
Spotkanie: {name}, {addr}
Klient {name}, telefon {phone}, sprawa {num}
Клиент {name} просит перезвонить: {phone}
Встреча с {name}, адрес {addr}, этаж {n}
Подписал {name}, дело {num}
O cliente {name} mudou para {addr}
Il signor {name} abita in {addr}
Mail sent to {email} after {n} tries
Undeliverable: {email} over quota
Forward {email} -> {email}
To: {email}, Cc: {email}
Subscriber {email} left list {w}
login mail {email} confirmed from {ip}
user typed "{email}" into field {w}
reset link for {email} expired after {n} s
From: "{name}" {email} lines={n}
from={email} to={email} relay={w}@{hex} bytes={n}
Absender {email}, Grund: {why}
Expéditeur {email} refusé, code {n}
Remitente {email} bloqueado
Отправитель {email} отклонён
call back on {phone}, ext follows
phone of record set to {phone} by {acc}
SMS to {phone} queued, part {n}
{phone} dialled {n} times
customer rang from {phone} at {hms}
numbers on file: {phone} / {phone}
Both {phone} and {phone} are busy
Rückruf unter {phone} erbeten
Numéro de secours {phone} enregistré
Número {phone} añadido por {acc}
Numer {phone} usunięty, wpis {n}
Телефон {phone} подтверждён
fax {phone}, pages {n}
{id} verified for case {num}
document check: {id}, result ok
applicant showed {id} at desk {n}
duplicate of {id}, kept by {name}
{id} is registered to {name} already
form {n}: {id}; consent given
typed {id} where a name was wanted
record {n} holds {id} and {phone}
Vorgelegt: {id}, gültig
Pièce présentée: {id}
Presentó {id} en ventanilla {n}
Okazano {id}, numer sprawy {num}
Предъявлен {id}, окно {n}
delivered to {addr} at {hms}
pickup moved to {addr}, slot {n}
van {n} waits at {addr} ({dec} km)
invoice {num} goes to {addr}, second copy to {addr}
address line without a town: {addr}
label for {addr}, {n} kg
site visit: {addr} with {name}
Zustellung {addr} fehlgeschlagen: {why}
Livraison au {addr}, colis {num}
Entrega en {addr}, paquete {n}
Przesyłka na adres {addr} zwrócona
Доставка по адресу {addr} отменена
file written for {name}, {addr}, to /srv/{w}/{n}.csv
{"name":"{name}","tel":"{phone}"}
{"caseId":{num},"customer":"{name}","contact":"{email}"}
{"caseId":{num},"tel":"{phone}","home":"{addr}","ok":true}
{"who":"{name}","where":"{addr}","when":"{ts}"}
{"email":"{email}","attempt":{n}}
{"caseId":{num},"applicant":{"{w}":"{w}","doc":"{id}"}}
args={"email":"{email}","text":"ring me on {phone}"} status={n}
args={"visitor":"{name}","place":"{addr}"} took={dec}
GET /people?mail={email} {n} {dec}ms
POST /signup mail={email} from {ip} status={n}
Customer said: my name is {name} and I live at {addr}, please ring {phone}.
A letter came from {name} today. The writer wants an answer to {email} by next week.
The tenant at {addr} is {name}; the spare key is with the neighbour.
We could not reach {name} on {phone}, so the parcel went back to the depot.
Message kept:\n{name}\n{addr}\n{phone}
Message kept:\\n{name}\\n{addr}\\n{phone}
Card {n}:\n  holder: {name}\n  mail: {email}\n  state: open
Card {n}:\\n  holder: {name}\\n  mail: {email}\\n  state: open
Card {n}:\n  call: {phone}\n  paper: {id}\n  state: open
Card {n}:\\n  call: {phone}\\n  paper: {id}\\n  state: open
Card {n}:\n  {w}Holder: {w} {w}\n  {w}Call: {w} {n}\n  state: shut
Card {n}:\\n  {w}Weight: {w} {w} {n}\\n  {w}Depth: {w} {n}\\n  state: shut
note by {name}: {w} {w} needs {n} days
[{Cls}] {name} unlocked drawer {n}
[{Cls}] sent reminder to {email}
[{Cls}] no reply from {phone} after {n} rings
{Cls}: {addr} geocoded in {dec} s
class {Cls}, letter for {name}, {addr}
class {Cls}, two contacts found: {phone} and {phone}
worker {n} started on {w} {w}
worker {n} stopped: {why}
retry {n} of {n} for {w} queue
request {uuid} refused by {w}: {why}
request {uuid} done in {dec} s
trace {hex}{hex} span {hex}
commit {hex} pushed to {w}/{w}
digest sha256:{hex}{hex}{hex} of {w} stored
job {num} finished, {n} rows kept, {n} rows gone
job {num} given to the {w} desk
claim {num} moved to {w} {w}
tracking {num} for parcel {n}-{n}
case {n}-{n} closed, see {num}
epoch 1799999999999 reached on {w}
lock {w}@{hex}/1799999999999 held by {w}
version {n}.{n}.{n} of {w} installed on {w}
build {n}.{n} failed on {w}@latest
disk {w} at {n}% after {hms}
clock off by {dec} s against {w}
heartbeat from {ip} lost, port {n}
heartbeat from {ip}:{n} back
session {hex} of {acc} ended after {n} calls
account {acc} locked: {why}
account {acc} opened a session from {ip}
sign-in of {acc} denied: {why}
grant {w}_{w} to {acc} until {ts}
revoke {w}_{w} from {acc}
member {given} voted for term {n}
peer {given} is leader of {w}
host {given} restarted by {acc}
{given} ({ip}) answers again
ring {given} has {n} of {n} members
vault {given} sealed
the field was masked, REDACTED kept in copy {n}
mail of the sender is [REDACTED], phone ***
street map {n} drawn, road layer {w} hidden
lane {n} of street {n} cleared for trucks
road sensor {n} reads {dec}
flat file {n} loaded into table {w}_{w}
avenue table {w} has {n} rows
drive {w} closed, drive {n} mounted
close of square {n} delayed
passport scanner {n} is offline
identity provider {w} answered in {dec} s
identity map {n} rebuilt, {n} keys
national holidays table loaded, {n} rows
phone gateway {w} is slow, {n} waiting
phone book sync: nothing new
no phone on file for case {num}
no mail on file, see note {n}
name server {w} answers in {dec} s
names of {n} files changed
title of page {num} is "{w} {w}"
customer index {w}: {n} entries
owner of {w} is {w} {w}
patient monitor {n} beeps
label for {w} {w} printed, tray {n}
pair of {w} and {w} merged, {n} left
{"{w}":"{w}","{w}":{n}}
{"{w}":"{w} {w}","panelId":{num},"depth":{dec}}
{"{w}":{"{w}":"{hex}{hex}","{w}":"99999"},"{w}":{n}}
{"flag":9999999,"{w}":"999999","{w}":"9999999999"}
GET /{w}/{n} {n} {dec}ms peer={ip}
PUT /{w}/{w} status={n} args={}
PUT /{w}/{w} status={n} args={"{w}":"{w} {w}","{w}":{n}}
select {w}_{w}, {w}_{w} from {w}_{w} where {w}_key = '{hex}' took {dec} s
select {w} from {w} where code = '9a99' rows={n}
query plan {num} dropped, cost {dec}
stack:\n  at {w}.{w}.{Cls}.run({Cls}.src:{n})\n  at {w}.{w}.{Cls}.call{W}({Cls}.src:{n})
error in {Cls}.load{W} line {n}: {why}
├── {w} {n}\n└── {w} {n}
The {w} of {W} is {n} meters long.
{W} {W} is the name of a {w} in the north.
The {w} team moved {n} boxes before the rain came. Nothing was lost.
Another try is planned for tonight because the {w} did not answer.
Two of the readers share one buffer, so the second has to wait for the first.
It isn't clear which of the copies is the newest one.
Der Dienst wurde wegen eines Fehlers angehalten, die Warteschlange bleibt bestehen.
Übertragung {n} abgebrochen: ungültige Länge
Straße {n} im Plan gesperrt, Größe {n}
Neuer Schlüssel für Gerät {n} gespeichert.
La copie {n} est terminée, il reste {n} fichiers à vérifier.
Rue {n} du plan effacée, délai dépassé
El envío {n} quedó en espera, la cola está llena.
La dirección de la calle {n} falta en el plano
Wpis {n} odrzucono, kolejka jest pełna.
Ulica {n} na mapie ukryta
Задание {n} выполнено, ошибок нет
Улица {n} на карте скрыта, ключ {n}
A fila {n} está cheia, tente amanhã.
CONEXÃO {n} ENCERRADA, SEM RESPOSTA
LA COLA {n} ESTÁ LLENA, MAÑANA SERÁ TARDE
Η σύνδεση {n} έληξε
Hàng đợi {n} đã đầy
队列 {n} 已满
キュー {n} が満杯です
{w} gauge shows {n} °C ± {dec}, price {n} €
{w} gauge: “{w}” – {n} units…
{w} {w} {id} {w} {w}
{w} {id} {w} {n}
{W} {w} {id}, {w} {w}
{w} {n}: {w} {w} {id} into {w}
{w} {w}; {id}; {w}
{id} {w} {w} {name}
{w} {w} of {name}: {id}
{w} gave {id} and {phone}
{w} {w} {phone} {w} {w}
{W} {w} {phone}, {w} {n}
{w}, new {w} {phone}
{w} us on {phone} before {w}
{w} {w} {w}, {w} {w} {phone}.
{w} {name} {w} {w}
{W} of {name} {w}, {w} {n}
{W} by {name} {w} us to {w}
{w} {w}: {name}
{w} {w} {name} {w}, {w} {w} {phone}
{w} {n} {w} {addr}
{W} {w} for {addr}, {w} {n} g
{w} {w} at {addr} ({dec} kg), {w} {w}
{w} {n} {w} town, {w} {w} {addr}
{w} {w} {email} {w} {w}
{W}: {email},{email} {w}, {w} {w}@{hex}
{W} {w} {num} to {email}
{W} {w} {num} to {w} {w}@{hex}
{w} {w} from {name}, {addr}, {w} /{w}/{w}/{n}
machine {given} joined the pool, load {dec}
Server {given} joined {w}, slot {n}
Worker {given} left {w}
Instance {given} of {w} stopped, {n} left
Broker {given} lost {n} messages
Alte Einträge entfernt, {n} Plätze übrig
Neue Schlüssel für Geräte gespeichert, {n} Fehler
Neuer Behälter angelegt, Kennung {hex}
Fehlende Berechtigung für Ordner {n}, Vorgang beendet.
Ältere Gehäuse gewählt, Größe {n}
Dernière Étape terminée, délai {dec} s
Última Página guardada, código {n}
Nowa Pozycja zapisana, wpis {n}
Новая Запись сохранена, номер {n}
ОШИБКА ДОСТУПА К ФАЙЛУ {n}
нОВАЯ ЗАПИСЬ СОХРАНЕНА, ОШИБОК НЕТ
ATENCIÓN: LÍNEA {n} CERRADA, ÍNDICE PERDIDO
{W} {w} {num}: {w} {w}
{W} {w} {n}: {why}
{W} {w} {num}:
{W} {w} {w} {n} {w}, {w} {num}
{W} {given} {w} {w}, {w} {n}
{W} {given} {w} by {acc}
{w} {id}, {w} {w} {name} {w}
{w} {n} {w}, {id} {w} {w} to {name}
{w}: {phone}\n    {w}: {id}\n    {w}: {w}
{w}: {phone}\\n    {w}: {id}\\n    {w}: {w}
    {w}: {n}\n    {w}: {phone}\n    {w}: {w}
    {w}: {n}\\n    {w}: {phone}\\n    {w}: {w}
    {w}: {n}\n    {w}: {name}\n    {w}: {email}
{w} {n} {w} from {w} ({num})
{w} {n} {w} from {w} ({hex})
Paket {n} für {name} angenommen
{W} {w} {name} {w} {w}, {addr}
{"{w}":"{addr}","{w}":"{name}"}
{"{w}":{num}, "{w}":"{phone}", "{w}":"{addr}"}
{W} ÃƒÂ¼{w} {n} Ã‚ {w}
ÃŒ {W} Ã‡ÃƒO {n} Ã€ {W}
ЗБРЙУШ {n} ХДБМЕОБ, ПЫЙВПЛ ОЕФ
дБООЩЕ УПИТБОЕОЩ {n}
FECHADO ATÉ À NOITE, LINHA {n}
VOLTE À {W} AMANHÃ, VERSÃO {n}
СОЕДИНЕНИЕ {n} НЕ УСТАНОВЛЕНО, ПОВТОРИТЕ ПОЗЖЕ
рПЧФПТЙФЕ РПЪЦЕ, УПЕДЙОЕОЙЕ {n} ОЕ ХУФБОПЧМЕОП
{W} {w} {num} - {why}
{w}: {num}
{w} {given} {w} {w} {w}, {w} {n}
Waiting for the {w} {w}...
Loading {w} {w}…
"""

# Ways to write numbers, papers, addresses, names and e-mail addresses.
FORMS = {
    "phone": [
        "+99 9 99 99 99 99", "(999) 999-9999", "+999 99 999 9999", "+99 9999 999999", "999.9999", "0099-9-999-999-99", "9-999-999-9999 x99", "+9 999-999-9999", "99999 999999", "999-9999", "+99 99 99999999", "999 999 999", "+99-999-9999999", "+999 9 999 9999", "09 99 99 99 99",
        "099/9999999", "+9 (999) 999-99-99", "999-999-9999", "999.999.9999", "+9999999999", "0999 999999", "+99 (0)99 9999 9999", "999.9999 ext. 99", "9-999-999-9999 x9", "+99.9.99.99.99.99", "0099 99 999 99 99", "+999 999 999 999", "9999 9999",
    ],
    "id": [
        "SSN [999-99-9999]", 'ssn="[999-99-9999]"', '"ssn":"[999999999]"', "social security no. [999-99-9999]", "passport no. [AA9999999]", "passport [A99999999]", "passport number [999999999]", "Reisepass [A99A9AA99]", "Ausweis-Nr. [A99999999A]", "Personalausweis [A99999999A]", "DNI [99999999-A]", "DNI [99999999A]", "NIE [A9999999A]", "personnummer [99999999-9999]",
        "personnummer [999999-9999]", "national id [999999-9999]", "national id [99.99.99-999.99]", "national identity number [999999999999]", "tax number [AA999.999.99]", "tax number [AA99.999.999]", "tax ref. [AA999.999.99]", "tax id [99-9999999]", "tax no. [999/999/99999]", "Steuer-ID [99 999 999 999]", "NINO [AA 99 99 99 A]", "NI number [AA999999A]", "PESEL [99999999999]", "CPF [999.999.999-99]", "codice fiscale [AAAAAA99A99A999A]",
        "identity card [999999999]", "ID card no. [AA999999]", "numéro de sécurité sociale [9 99 99 99 999 999]", "ИНН [999999999999]", "паспорт [9999 999999]", '"passport":"[AA9999999]"', '"national_id":"[999999-9999]"', '"tax_id":"[AA999.999.99]"', "driving licence [AAAAA999999AA9AA]",
    ],
    "addr": [
        "Flat 99, 999 W Lane, T", "Flat 9, 99 W Lane, T", "999 W Avenue, Apt 99", "99 F Avenue, Apt 9", "Calle W 999, T", "Calle W 99", "ul. W 99, 99-999 T", "ul. W 99/9, 99-999 T", "99 rue du W, T", "9 rue de W, 99999 T", "999 W Road, T", "99 W Road", "99A Old W Street", "999 F Street, T", "Wweg 99, 99999 T", "Wstraße 9, 99999 T", "Fstraße 99",
        "via W 99, 99999 T", "99 W Drive, T", "9 W Close, T", "99 W Square", "999 Upper W Street", "Wgasse 9, 99999 T", "avenida W 99, T", "plaza de W 9, T", "99 boulevard W, 99999 T", "rua W 999, T", "Apt 9, 99 W Street, T", "Unit 9, 999 W Road, T", "W-Allee 99, 99999 T", "al. W 9, 99-999 T", "999 North W Avenue, T",
    ],
    "name": ["G F", "G F", "G F", "G A. F", "A. F", "F, G", "F, G", "G A F", "Herr F", "Mme F", "Dr. F", "Mr. F", "Mrs F", "Frau F", "Ms F", "g f", "G-U F-U", "Herr G F", "Prof. A. F", "Sra. F", "Pan F", "Señor F", "F, A."],
    "email": ["g.f@D", "f+list@D", "g_99@D", "g_9@D", "xf@D", "g-f@D", "<g.f@D>", "<f+list@D>", "mailto:g.f@D", "g.f (at) O", "f+list (at) O", "g_99 (at) O", "G.F@D-U", "g@D", "g.w@D", "w@D", "f.g99@D", "mailto:xf@D", "g.f [at] D", "fg@D", "<xf@D>"],
}
WHY = ["queue is full", "permission denied", "stale handle", "no route to peer", "checksum mismatch", "token was revoked", "quota reached", "lease expired", "schema differs", "closed by the other side", "time is up", "not found"]
TOWN_ENDS = ["wick", "by", "mouth", "stead", "ton", "ham", "burg", "ville", "field", "ford", "dorf"]
HOSTS = ["quiet.test", "post.meadow.example", "stone-bridge.invalid", "b.test", "garden.example", "mail.southport.com", "c-side.org", "company.de", "courrier.fr", "inbox.co.uk"]


def held_out(items: list[str], third: int) -> tuple[list[str], list[str]]:
    """(items to learn from, items to be judged by): every third one from `third` on is held out; items written twice are held out together."""
    unique = list(dict.fromkeys(items))
    out = set(unique[third::3])
    return [x for x in items if x not in out], [x for x in items if x in out]
