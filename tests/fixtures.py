"""Constants that tests share."""

SF = "/root/testdata/sf0.001"

#: Cell -> centre row, centre column, radius, radius of the nucleus.
DISKS = {1: (120, 120, 40, 15), 2: (120, 300, 45, 18), 3: (300, 120, 38, 14), 4: (300, 300, 42, 16), 5: (400, 400, 35, 13)}
