"""Small tables as csv files: a textbook's suppliers and parts for the algebra, and boats for programs."""

import os

# The public textbook example of suppliers (S), parts (P), shipments (SP) and part structure (MM).
S = """S#,SNAME,STATUS,CITY
S1,Smith,20,London
S2,Jones,10,Paris
S3,Blake,30,Paris
S4,Clark,20,London
S5,Adams,30,Athens
"""
P = """P#,PNAME,COLOR,WEIGHT,CITY
P1,Nut,Red,12.0,London
P2,Bolt,Green,17.0,Paris
P3,Screw,Blue,17.0,Oslo
P4,Screw,Red,14.0,London
P5,Cam,Blue,12.0,Paris
P6,Cog,Red,19.0,London
"""
SP = """S#,P#,QTY
S1,P1,300
S1,P2,200
S1,P3,400
S1,P4,200
S1,P5,100
S1,P6,100
S2,P1,300
S2,P2,400
S3,P2,200
S4,P2,200
S4,P4,300
S4,P5,400
"""
MM = """MAJOR,MINOR
P1,P2
P1,P3
P2,P3
P2,P4
P3,P5
P4,P6
"""

# Crews, boats, trips and legs, made up for these tests.
CREW = """member,name,grade,port
k1,Ines,3,Vigo
k2,Olaf,1,Bergen
k3,Mara,3,Bergen
k4,Teo,2,Vigo
k5,Runa,5,Turku
"""
BOAT = """boat,kind,meters,port
b1,sloop,9.5,Vigo
b2,ketch,14,Bergen
b3,yawl,12,Turku
b4,sloop,8,Lisbon
"""
TRIP = """member,boat,days
k1,b1,4
k1,b2,7
k1,b3,2
k2,b2,7
k3,b1,1
k3,b4,3
k4,b4,10
"""
LEG = """start,finish
a,b
b,c
c,d
b,e
f,g
"""
TABLES = {"S": S, "P": P, "SP": SP, "MM": MM, "CREW": CREW, "BOAT": BOAT, "TRIP": TRIP, "LEG": LEG}
DECLARED = """
var CREW:{member, name, grade:number, port}(csv)
var BOAT:{boat, kind, meters:number, port}(csv)
var TRIP:{member, boat, days:number}(csv)
var LEG(csv)
"""


def write_tables(folder) -> str:
    """One file with a byte order mark and one without a last line end, as found in the wild."""
    for name, lines in TABLES.items():
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf-8-sig" if name in ("S", "CREW") else "utf-8") as f:
            f.write(lines.rstrip("\n") if name in ("P", "BOAT") else lines)
    return str(folder)
