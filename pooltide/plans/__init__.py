"""Reports: compositions of operators over coupons, legs and features."""
