"""Titles and the names that they are normalised to."""

# Fixed values, in their own order.
TITLES = {
    "frontend engineer": "Frontend Developer",
    "sre gitlab": "Site Reliability Engineer",
    "systems architect microsoft": "Solutions Architect",
    "devsecops engineer": "DevOps Engineer",
    "cloud security engineer": "Security Engineer",
    "network automation engineer nokia": "Network Engineer",
    "embedded linux engineer": "Embedded Systems Engineer",
    "plc/scada engineer siemens": "Manufacturing Engineer",
    "renewable energy engineer solaredge": "Manufacturing Engineer",
    "process engineer shell": "Manufacturing Engineer",
    "power systems engineer ge power": "Manufacturing Engineer",
    "aml analyst hsbc": "Risk Analyst",
    "payment systems engineer paypal": "Software Engineer",
    "sap consultant infosys": "IT Consultant",
    "growth hacker": "Software Engineer",
    "full stack developer": "Full Stack Engineer",
    "tableau developer": "BI Developer",
    "spark developer": "Data Engineer",
    "ci/cd engineer circleci": "DevOps Engineer",
    "solutions architect": "Cloud Architect",
    "identity management engineer okta": "Security Engineer",
    "kafka engineer": "Data Engineer",
    "ruby on rails engineer basecamp": "Backend Engineer",
    "vue.js developer tiktok": "Frontend Engineer",
    "backend python developer pinterest": "Backend Engineer",
    "senior ux designer": "UI/UX Designer",
    "c++ engineer qualcomm": "Embedded Systems Engineer",
    "microservices architect lyft": "Software Architect",
    "terraform engineer hashicorp": "DevOps Engineer",
    "systems engineer mozilla": "Software Engineer",
    "aws solutions engineer amazon": "Cloud Architect",
    "rpa engineer uipath": "Software Engineer",
    "ui developer": "Frontend Engineer",
    "kubernetes administrator digitalocean": "DevOps Engineer",
    "python api developer fastly": "Backend Engineer",
    "supply chain engineer": "IT Consultant",
    "observability engineer datadog": "DevOps Engineer",
    "iot engineer bosch": "Embedded Systems Engineer",
    "sap abap developer sap": "Software Engineer",
    "hpc engineer nvidia": "Software Engineer",
    "java spring engineer pivotal": "Backend Engineer",
    "elixir developer discord": "Backend Engineer",
    "go developer hashicorp": "Backend Engineer",
    "marketing automation specialist salesforce": "Digital Marketing Manager",
    "research scientist": "Computer Vision Engineer",
    "erp consultant oracle": "IT Consultant",
    "pipeline engineer airbnb": "Data Engineer",
    "django developer automattic": "Backend Engineer",
    "ux researcher google": "UI/UX Designer",
    "statistician who": "Data Analyst",
    "scada engineer abb": "Manufacturing Engineer",
    "service mesh engineer lyft": "Platform Engineer",
    "electron developer slack": "Frontend Engineer",
    "legaltech engineer thomson reuters": "Software Engineer",
    "webassembly engineer fastly": "Software Engineer",
    "medical informatics analyst mayo clinic": "Healthcare IT Engineer",
    "algorithmic trading engineer bloomberg": "Software Engineer Finance",
    "power bi manager walmart": "BI Developer",
    "unity engineer ea games": "Game Developer",
    "qlik developer gartner": "BI Developer",
    "compliance officer barclays": "GRC Analyst",
    "microcontroller engineer stmicroelectronics": "Embedded Systems Engineer",
    "supply chain manager amazon": "IT Consultant",
    "mainframe developer ibm": "Software Engineer",
    "malware analyst": "Security Analyst",
    "graphql engineer prisma": "Backend Engineer",
    "grid systems engineer siemens energy": "Manufacturing Engineer",
    "flutter senior developer google": "Mobile Developer",
    "c# .net engineer microsoft": "Backend Engineer",
    "deep learning researcher stanford ai lab": "AI Researcher",
    "pcb design engineer cisco hardware": "Hardware Engineer",
    "rpa developer uipath": "Software Engineer",
    "open source developer apache foundation": "Software Engineer",
    "monitoring engineer new relic": "DevOps Engineer",
    "lean manufacturing consultant toyota consulting": "Manufacturing Engineer",
    "cto fintech startup": "CTO",
    "platform engineer": "Embedded Systems Engineer",
    "frontend developer": "Frontend Engineer",
}
