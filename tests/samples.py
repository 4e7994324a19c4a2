"""Raw texts in the shapes the parse jobs read; players, cards and amounts are made up."""

SHOWDOWN_HAND = """
Poker Hand #TX500600: Tournament #4711, Harbour Night Special $2.50 Hold'em No Limit - Level12(500/1,000) - 2026/03/04 21:07:09
Table '31' 6-max Seat #5 is the button
Seat 1: mara (12,400 in chips)
Seat 3: Hero (9,250 in chips)
Seat 5: olof (30,010 in chips)
Seat 6: quill (8,000 in chips)
mara: posts the ante 100
Hero: posts the ante 100
olof: posts the ante 100
quill: posts the ante 100
quill: posts small blind 500
mara: posts big blind 1,000
*** HOLE CARDS ***
Dealt to mara 
Dealt to Hero [Qs Qd]
Dealt to olof 
Hero: raises 1,200 to 2,200
olof: raises 4,400 to 6,600
quill: folds
mara: folds
Hero: calls 4,400
*** FLOP *** [Qh 8c 3d]
Hero: checks
olof: bets 5,000
Hero: calls 2,550 and is all-in
Uncalled bet (2,450) returned to olof
Hero: shows [Qs Qd]
olof: shows [Ac Ah]
*** TURN *** [Qh 8c 3d] [9s]
*** RIVER *** [Qh 8c 3d 9s] [As]
*** SHOWDOWN ***
olof collected 20,200 from pot
*** SUMMARY ***
Total pot 20,200 | Rake 0 | Jackpot 0
Board [Qh 8c 3d 9s As]
Seat 1: mara (big blind) folded before Flop
Seat 3: Hero showed [Qs Qd] and lost with three of a kind, Queens
Seat 5: olof (button) showed [Ac Ah] and won (20,200) with three of a kind, Aces
Seat 6: quill (small blind) folded before Flop
""".strip()

QUIET_HAND = """
Poker Hand #TX500601: Tournament #4711, Harbour Night Special $2.50 Hold'em No Limit - Level3(40) - 2026/03/04 20:11:00
Table '31' 6-max Seat #1 is the button
Seat 1: Hero (3,300 in chips)
Seat 2: mara (2,900 in chips)
*** HOLE CARDS ***
Dealt to Hero [Kc 4h]
Hero: calls 40
mara: checks
*** FLOP *** [Jc 7d 2s]
mara: bets 80
Hero: folds
Uncalled bet (80) returned to mara
mara collected 160 from pot
*** SUMMARY ***
Total pot 160 | Rake 0 | Jackpot 0
Seat 1: Hero (button) folded on the Flop
Seat 2: mara (big blind) collected (160)
""".strip()

SECOND_PLACE = """
Tournament #880011, Harbour Night Special $20, Hold'em No Limit
Buy-in: $9+$1.6+$9.4
24 Players
Total Prize Pool: $441.6
Tournament started 2026/03/04 19:30:00 
2nd : Hero, $65
""".strip()

LATE_BUST = """
Tournament #880012, Harbour Night Special $20, Hold'em No Limit
Buy-in: $9+$1.6+$9.4
24 Players
23rd : Hero, $0
""".strip()
