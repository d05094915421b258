"""Labelled exemplars: left-over text, and ordinary sentences that report about such text.

Only the words that every case of a kind shares are given; names, numbers and addresses are left out. FIELD stands
for an unfilled template field. A line that repeats a word needs it as often.
"""

FIELD = "unfilledtemplatefield"

RESIDUE = {
    "template": f"""
        {FIELD}
        yyyy mm dd
        mm dd yyyy
        tt mm jjjj
        undefined undefined
        null null null
        nan nan nan
        your name here
        insert name here
        name hier einfügen
    """,
    "filler": """
        lorem ipsum dolor sit amet
        consectetur adipiscing elit sed do eiusmod
        text text text text
        blah blah blah
        bla bla bla
        sample text goes here
        your text goes here
        this is dummy copy for layout purposes only
        description to be added later by author
        replace this paragraph with your own content
        type the summary in this box
        enter the summary in this field
        content to be added later
        dies ist ein blindtext und dient nur dem layout
        hier steht später der eigentliche text
        beschreibung wird vom verfasser nachgereicht
        zusammenfassung in dieses feld eingeben
        ersetzen sie diesen absatz durch ihren eigenen inhalt
        diesen absatz durch eigenen inhalt ersetzen
        beispieltext bitte ersetzen
        hier kommt der text hin
        platzhaltertext bitte ersetzen
    """,
    "error": """
        404 the page could not be found
        404 page not found
        404 die seite wurde nicht gefunden
        404 seite nicht gefunden
        go back to the start page or search for
        zurück zur startseite oder suche nach
        the requested document no longer exists or was moved to
        das angeforderte dokument existiert nicht mehr oder liegt jetzt in
        http error is temporarily unavailable retry after seconds
        http fehler ist vorübergehend nicht erreichbar neuer versuch in sekunden
        500 internal server error
        internal server error in module at
        interner serverfehler im modul um
        502 bad gateway upstream request
        503 service unavailable
        gateway timeout after ms while reading
        504 gateway timeout
        zeitüberschreitung nach ms beim lesen von
        connection to database refused on port
        verbindung zur datenbank auf port abgelehnt
        too many requests from limit is per minute
        zu viele anfragen von erlaubt sind pro minute
        access denied your account may not open
        access denied you do not have permission
        your account may not open
        zugriff verweigert ihr konto darf nicht öffnen
        ihr konto darf nicht öffnen
        403 forbidden
        your session has expired sign in to again
        ihre sitzung ist abgelaufen bitte erneut bei anmelden
        oops we can t load this view of right now
        we can t load this view of right now
        oops something went wrong
        hoppla diese ansicht von lässt sich gerade nicht laden
        diese ansicht von lässt sich gerade nicht laden
        da ist etwas schiefgelaufen
        error code trace message upstream request failed
        fehler code spur text abruf der gegenstelle fehlgeschlagen
        traceback most recent call last
        traceback line in value missing for
        something went wrong on our side quote when you write to
        bei uns ist etwas schiefgelaufen nennen sie wenn sie schreiben
        ablaufverfolgung zeile in wert fehlt für
        exception in thread main
    """,
    "scripts": """
        please enable javascript to continue to
        you need to allow javascript to view
        you need to enable javascript to run this app
        javascript is disabled cannot be displayed
        javascript is required
        this app needs scripts turn them on in your browser and reload
        this app needs scripts
        turn them on in your browser and reload
        scripts are switched off the form with stays hidden
        your browser blocks active content so will not start
        noscript activate scripting support for portal
        bitte aktivieren sie javascript um zu nutzen
        zum anzeigen von muss javascript erlaubt sein
        javascript ist deaktiviert kann nicht dargestellt werden
        javascript wird benötigt
        diese anwendung benötigt skripte bitte im browser einschalten und neu laden
        diese anwendung benötigt skripte
        bitte im browser einschalten und neu laden
        skripte sind abgeschaltet das formular mit feldern bleibt verborgen
        ihr browser blockiert aktive inhalte daher startet nicht
        noscript skriptausführung für das portal zulassen
    """,
}

#: Passages whose words come in any order: a window counts by how much of its own weight the passage covers.
PASSAGES = {
    "filler": """
        lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
        lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat sed diam voluptua at vero eos et accusam et justo duo dolores et ea rebum stet clita kasd gubergren no sea takimata sanctus est
        asdf jkl jklö asdf asdfg asdfgh hjkl ghjkl qwer qwert qwertz qwerty tzui yuiop uiop uiopü yxcv zxcv vbnm cvbn sdfg fdsa
        foo bar baz qux quux foobar
    """,
}

REPORT = f"""
    the merge field {FIELD} is filled by since version as reported
    das seriendruckfeld {FIELD} wird seit version von befüllt wie meldete
    das muster tt mm jjjj gilt für alle in so die abteilung
    the pattern yyyy mm dd applies to all in according to
    the pattern yyyy mm dd is used for all in
    the pattern mm dd yyyy applies to all in according to
    a 404 page for was designed by and costs
    eine 404 seite für wurde von gestaltet und kostet
    access denied messages in fell by after cleaned the groups
    meldungen über verweigerten zugriff in sanken um nachdem die gruppen bereinigt hatte
    users without javascript saw a hint in and reworded it for
    nutzer ohne javascript sahen in einen hinweis der für umformuliert wurde
    the agency from had used lorem ipsum in the draft which replaced before print
    die agentur hatte im entwurf blindtext verwendet den die vor dem druck ersetzte
    during the test on the portal answered with error for minutes until stepped in
    beim test am antwortete das portal minuten lang mit fehler bis eingriff
    der platzhalterbestand in umfasst für
"""
