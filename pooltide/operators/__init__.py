"""DataFrame operators. A coupon holds a handful of legs (15 by the rules of the
game), so grouping by coupon is grouping by record; every other grouping key
(type, league, account, competition, date) may be hot and is either aggregated
map-side first or cut into blocks (see ``ordered``)."""
