"""Query, artist, track — the labelled set a parser is measured on."""

LABELLED = [
    ("Aphex Twin - Windowlicker", "aphex twin", "windowlicker"),
    ("aphex twin - windowlicker [FLAC]", "aphex twin", "windowlicker"),
    ("Boards of Canada - Dayvan Cowboy.mp3", "boards of canada", "dayvan cowboy"),
    ("Radiohead - Kid A (2000) 320kbps", "radiohead", "kid a"),
    ("C:\\Music\\Portishead - Glory Box.flac", "portishead", "glory box"),
    ("/home/user/music/Massive Attack - Angel.flac", "massive attack", "angel"),
    ("01 - Massive Attack - Teardrop.mp3", "massive attack", "teardrop"),
    ("Björk - Jóga", "bjork", "joga"),
    ("The Beatles - Hey Jude [FLAC 24bit]", "the beatles", "hey jude"),
    ("Simon & Garfunkel - The Boxer", "simon & garfunkel", "the boxer"),
    ("Miles Davis – Kind of Blue", "miles davis", "kind of blue"),
    ("Autechre - Gantz Graf 320kbps", "autechre", "gantz graf"),
    ("Kraftwerk - Autobahn (1974) vinyl rip", "kraftwerk", "autobahn"),
    ("DJ Shadow - Midnight in a Perfect World.wav", "dj shadow", "midnight in a perfect world"),
    ("Squarepusher - My Red Hot Car [WEB]", "squarepusher", "my red hot car"),
    ("Nils Frahm - Says", "nils frahm", "says"),
    ("Pink Floyd - Time - Remastered", "pink floyd", "time"),
    (
        "Flying Lotus - Never Catch Me feat Kendrick Lamar",
        "flying lotus",
        "never catch me feat kendrick lamar",
    ),
    ("GAS - Pop", "gas", "pop"),
    ("  Deftones   -   Digital Bath  ", "deftones", "digital bath"),
    ("Jay-Z - 99 Problems", "jay-z", "99 problems"),
    ("AC/DC - Back in Black", "ac dc", "back in black"),
    ("Fleetwood Mac - Dreams 24bit 96khz", "fleetwood mac", "dreams"),
    ("Godspeed You! Black Emperor - Storm", "godspeed you black emperor", "storm"),
    ("Sigur Rós - Hoppípolla", "sigur ros", "hoppipolla"),
    ("Céline Dion - My Heart Will Go On", "celine dion", "my heart will go on"),
    ("Wu-Tang Clan - Triumph", "wu-tang clan", "triumph"),
    ("Daft Punk - Around the World (Radio Edit)", "daft punk", "around the world"),
    ("Metallica - Master of Puppets 1986", "metallica", "master of puppets"),
    ("Moderat - A New Error", "moderat", "a new error"),
    ("Röyksopp - Eple", "royksopp", "eple"),
    ("Bonobo - Kong.flac", "bonobo", "kong"),
    ("Four Tet – Two Thousand and Seventeen", "four tet", "two thousand and seventeen"),
    ("Nujabes - Feather cd rip", "nujabes", "feather"),
    ("Photek - Ni Ten Ichi Ryu v0", "photek", "ni ten ichi ryu"),
    ("Aphex Twin - Windowlicker - v2 - 320kbps", "aphex twin", "windowlicker"),
    ("aphex twin discography", "aphex twin", ""),
    ("the cure greatest hits", "the cure", ""),
    ("Amon Tobin - Bricolage full album", "amon tobin", ""),
    ("Burial", "burial", ""),
    ("burial untrue", "burial untrue", ""),
    ("aphex twin selected ambient works", "aphex twin selected ambient works", ""),
    ("", "", ""),
    ("     ", "", ""),
    ("[FLAC] 320kbps", "", ""),
    ("Tycho- Awake", "tycho", "awake"),
    ("Nine Inch Nails-Hurt", "nine inch nails", "hurt"),
]
MINIMUM_ACCURACY = 0.85
