"""Expected values of a small home market, as published with its listings.

Fixed values: these rows are published results that both tie rules and the trailing year must match.

Columns: listed, sold, amount, category, inventory after the listing, listings so far in the year,
sales in the 365 days before, months of inventory. Rows are in listing order; later listings do not
change earlier values.
"""

ROWS = """
2017-01-02,2017-07-12,217000,residential,1,1,0,
2017-01-11,2017-08-30,235000,residential,2,2,0,
2017-01-11,2017-09-11,223500,residential,3,3,0,
2017-02-24,2017-05-19,177777,residential,4,4,0,
2017-02-24,2017-06-22,156000,residential,5,5,0,
2017-03-24,2017-05-15,182000,residential,6,6,0,
2017-04-24,2017-07-28,252999,residential,7,7,0,
2017-05-01,2017-08-14,189900,residential,8,8,0,
2017-05-01,2017-08-01,177000,residential,9,9,0,
2017-05-18,2017-08-21,218000,residential,9,10,1,108
2017-06-05,2017-09-21,198000,residential,9,11,2,54
2017-07-28,2017-10-02,175000,residential,8,12,5,19.2
2017-09-19,2018-04-13,219500,residential,3,13,10,3.6
2017-11-09,2017-12-21,189900,patio home,2,14,12,2
2018-01-01,2018-05-07,232500,residential,2,1,13,1.8461538461538463
2018-01-19,2018-06-22,355000,residential,3,2,13,2.769230769230769
2018-01-22,2018-02-01,208900,residential,4,3,13,3.6923076923076925
2018-02-05,2018-03-19,212500,residential,4,4,14,3.4285714285714284
2018-02-06,2018-08-21,198500,residential,5,5,14,4.285714285714286
2018-02-06,2018-03-29,165000,townhome,6,6,14,5.142857142857142
2018-02-09,2018-05-14,314900,residential,7,7,14,6
2018-02-11,2018-03-20,190000,residential,8,8,14,6.857142857142857
2018-02-12,2018-09-13,268000,residential,9,9,14,7.714285714285715
2018-03-05,2018-09-28,221000,patio home,10,10,14,8.571428571428571
2018-03-08,2018-04-17,187000,townhome,11,11,14,9.428571428571429
2018-03-23,2018-07-03,235900,residential,10,12,16,7.5
2018-04-11,2018-12-29,210000,residential,10,13,17,7.0588235294117645
2018-05-03,2019-08-02,290000,residential,9,14,19,5.684210526315789
2018-05-25,2019-08-07,223000,residential,8,15,19,5.052631578947368
2018-07-10,2018-08-31,212900,residential,7,16,20,4.2
2018-07-22,2019-09-18,365000,residential,8,17,19,5.052631578947368
2018-07-30,2019-06-16,203000,residential,9,18,18,6
2018-08-03,2018-09-21,181700,residential,10,19,17,7.0588235294117645
"""
# Line through the running amount of the 2017 sales over the day of the year.
SLOPE_2017 = 12927.0524
R_SQUARED_2017 = 0.903676
