"""Writers: tables, reports, review sheets, dashboards, archives."""
