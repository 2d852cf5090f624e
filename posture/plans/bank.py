"""The question bank: a fixed dimension table of 151 published questions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Areas and their display names, in report order.
PILLARS = {
    "data-ai-governance": "Data & AI Governance",
    "interoperability-usability": "Interoperability & Usability",
    "operational-excellence": "Operational Excellence",
    "security-compliance-privacy": "Security, Compliance & Privacy",
    "reliability": "Reliability",
    "performance-efficiency": "Performance Efficiency",
    "cost-optimization": "Cost Optimization",
}

# Fixed values: "# area", "## principle", then one question per line, in bank order.
BANK = """
# data-ai-governance
## Unify data and AI management
DG-01-01 Establish data governance process
DG-01-02 Manage metadata for all data assets in one place
DG-01-03 Track data and AI lineage to drive visibility of the data
DG-01-04 Add consistent descriptions to your metadata
DG-01-05 Allow easy data discovery for data consumers
DG-01-06 Govern AI assets together with data
## Unify data and AI security
DG-02-01 Centralize access control for all data and AI assets
DG-02-02 Configure audit logging
DG-02-03 Audit data platform events
## Establish data quality standards
DG-03-01 Define and document data quality standards
DG-03-02 Use data quality tools for profiling, cleansing, validating, and monitoring data
DG-03-03 Implement and enforce standardized data formats and definitions
# interoperability-usability
## Define standards for integration
IU-01-01 Use standard and reusable integration patterns for external integration
IU-01-02 Use optimized connectors to ingest data sources into the lakehouse
IU-01-03 Use certified partner tools
IU-01-04 Reduce complexity of data engineering pipelines
## Utilize open interfaces and data formats
IU-02-01 Use open data formats
IU-02-02 Enable secure data sharing for all data and AI assets
IU-02-03 Use open standards for your AI workflows
## Simplify new use case implementation
IU-03-01 Provide a self-service experience across the platform
IU-03-02 Use serverless services
IU-03-03 Use pre-defined compute templates
IU-03-04 Use AI capabilities to increase productivity
## Ensure data consistency and usability
IU-04-01 Offer reusable data-as-products that the business can trust
IU-04-02 Publish data products semantically consistent across the enterprise
IU-04-03 Provide a central catalog for discovery and lineage
# operational-excellence
## Optimize build and release processes
OE-01-01 Create a dedicated Lakehouse operations team
OE-01-02 Use enterprise source code management (SCM)
OE-01-03 Standardize DevOps processes (CI/CD)
OE-01-04 Standardize MLOps processes across enterprise
OE-01-05 Define environment isolation strategy
OE-01-06 Streamline the usage and management of various large language model (LLM) providers
OE-01-07 Define catalog strategy for your enterprise using Unity Catalog
OE-01-08 Compare LLM outputs on set prompts
OE-01-09 Build models with all representative, accurate and relevant data sources
## Automate deployments and workloads
OE-02-01 Use Infrastructure as Code for deployments and maintenance
OE-02-02 Standardize compute configurations
OE-02-03 Use automated workflows for jobs
OE-02-04 Use automated and event driven file ingestion
OE-02-05 Use ETL frameworks for data pipelines
OE-02-06 Follow the deploy-code approach for ML workloads
OE-02-07 Use a model registry to decouple code and model lifecycle
OE-02-08 Automate ML experiment tracking
OE-02-09 Reuse the same infrastructure to manage ML pipelines
OE-02-10 Utilize declarative management for complex data and ML pipelines
OE-02-11 Automate LLM evaluation
## Set up Monitoring, Alerting and Logging
OE-03-01 Establish monitoring processes
OE-03-02 Use native and external tools for platform monitoring
OE-03-03 Establish an incident response strategy
OE-03-04 Triggering actions in response to a specific event
## Manage capacity and quotas
OE-04-01 Manage service limits and quotas
OE-04-02 Invest in capacity planning
# security-compliance-privacy
## Manage identity and access using least privilege
SCP-01-01 Authenticate via single sign-on.
SCP-01-02 Use multifactor authentication.
SCP-01-03 Disable local passwords.
SCP-01-04 Set complex local passwords.
SCP-01-05 Separate admin accounts from normal user accounts.
SCP-01-06 Use token management.
SCP-01-07 SCIM synchronization of users and groups.
SCP-01-08 Limit cluster creation rights.
SCP-01-09 Use secret management for credentials
SCP-01-10 Configure cloud permissions with least privilege
SCP-01-11 Customer-approved workspace login.
SCP-01-12 Use clusters that support user isolation.
SCP-01-13 Use service principals to run production jobs.
## Protect data in transit and at rest
SCP-02-01 Avoid storing production data in DBFS.
SCP-02-02 Secure access to cloud storage.
SCP-02-03 Implement data exfiltration protection
SCP-02-04 Use bucket versioning.
SCP-02-05 Encrypt storage and restrict access.
SCP-02-06 Add a customer-managed key for managed services.
SCP-02-07 Configure network-based data exfiltration protection
## Secure your network and identify and protect endpoints
SCP-03-01 Deploy with a customer-managed VPC or VNet.
SCP-03-02 Configure IP access lists
SCP-03-03 Implement network exfiltration controls
SCP-03-04 Implement private access policies for console
SCP-03-05 Configure VPC endpoint access policies
SCP-03-06 Use Private Link for secure connectivity
## Review the Shared Responsibility Model
SCP-04-01 Review the Shared Responsibility Model.
## Meet compliance and data privacy requirements
SCP-05-01 Follow security and compliance guidance
## Monitor system security
SCP-06-01 Use observability tools like Overwatch
SCP-06-02 Use system tables for audit logs
SCP-06-03 Analyze audit logs regularly
SCP-06-04 Use Enhanced Security Monitoring or Compliance Security Profile
SCP-06-05 Configure tagging to monitor usage and enable charge-back.
## Generic controls
SCP-07-01 Use AWS Nitro instances.
SCP-07-02 Service quotas.
SCP-07-03 Leverage CI/CD processes to scan code for hard-coded secrets.
SCP-07-04 Isolate sensitive workloads into different workspaces.
SCP-07-05 Controlling libraries.
# reliability
## Design for failure
R-01-01 Use a data format that supports ACID transactions
R-01-02 Use a resilient distributed data engine for all workloads
R-01-03 Automatically rescue invalid or nonconforming data
R-01-04 Configure jobs for automatic retries and termination
R-01-05 Use a scalable and production-grade model serving infrastructure
R-01-06 Use managed services for your workloads
## Manage data quality
R-02-01 Use a layered storage architecture
R-02-02 Improve data integrity by reducing data redundancy
R-02-03 Actively manage schemas
R-02-04 Use constraints and data expectations
R-02-05 Take a data-centric approach to machine learning
## Design for autoscaling
R-03-01 Enable autoscaling for ETL workloads
R-03-02 Use autoscaling for SQL Warehouses
## Test recovery procedures
R-04-01 Recover from Structured Streaming query failures
R-04-02 Recover ETL jobs using data time travel capabilities
R-04-03 Leverage a job automation framework with built-in recovery
R-04-04 Configure a disaster recovery pattern
## Monitor platform events
R-05-01 Monitor data platform events
R-05-02 Monitor cloud events
# performance-efficiency
## Utilize serverless capabilities
PE-01-01 Use serverless architecture
PE-01-02 Use an enterprise grade model serving service
## Design workloads for performance
PE-02-01 Understand your data ingestion and access patterns
PE-02-02 Use parallel computation where it is beneficial
PE-02-03 Analyze the whole chain of execution
PE-02-04 Prefer larger clusters
PE-02-05 Use native Spark operations
PE-02-06 Use native platform engines
PE-02-07 Understand your hardware and workload type
PE-02-08 Use caching
PE-02-09 Use compaction
PE-02-10 Use data skipping
PE-02-11 Enable Predictive Optimization on your metastore
PE-02-12 Avoid over-partitioning
PE-02-14 Consider file size tuning
PE-02-15 Optimize join performance
PE-02-16 Run analyze table to collect table statistics
## Run performance testing
PE-03-01 Test on data representative of production data
PE-03-02 Take prewarming of resources into account
PE-03-03 Identify bottlenecks
## Monitor performance
PE-04-01 Monitor query performannce
PE-04-02 Monitor streaming workloads
PE-04-03 Monitor job performance
# cost-optimization
## Choose optimal resources
CO-01-01 Use performance optimized data formats
CO-01-02 Use job clusters
CO-01-03 Use SQL warehouse for SQL workloads
CO-01-04 Use up-to-date runtimes for your workloads
CO-01-05 Only use GPUs for the right workloads
CO-01-06 Use Serverless for your workloads
CO-01-07 Use the right instance type
CO-01-08 Choose the most efficient cluster size
CO-01-09 Evaluate performance optimized query engines
## Dynamically allocate resources
CO-02-01 Leverage auto-scaling compute
CO-02-02 Use auto termination
CO-02-03 Use compute policies to control costs
## Monitor and control cost
CO-03-01 Monitor costs
CO-03-02 Tag clusters for cost attribution
CO-03-03 Implement observability to track & chargeback cost
CO-03-04 Share cost reports regularly
CO-03-05 Monitor and manage Delta Sharing egress costs
## Design cost-effective workloads
CO-04-01 Balance always-on and triggered streaming
CO-04-02 Balance between on-demand and capacity excess instances
"""

SCHEMA = (
    "ordinal int, pillar_ordinal int, pillar_id string, pillar string, principle string,"
    " question_id string, question string"
)


@dataclass(frozen=True)
class Question:
    ordinal: int
    pillar_id: str
    principle: str
    question_id: str
    title: str


@cache
def questions() -> tuple[Question, ...]:
    found: list[Question] = []
    pillar_id = principle = ""
    for line in BANK.strip().splitlines():
        mark, _, text = line.partition(" ")
        if mark == "#":
            pillar_id = text
        elif mark == "##":
            principle = text
        else:
            found.append(Question(len(found), pillar_id, principle, mark, text))
    return tuple(found)


def question_bank(spark: SparkSession) -> DataFrame:
    """All questions in bank order. 151 rows, so safe to broadcast."""
    position = {p: i for i, p in enumerate(PILLARS)}
    rows = [
        (
            q.ordinal,
            position[q.pillar_id],
            q.pillar_id,
            PILLARS[q.pillar_id],
            q.principle,
            q.question_id,
            q.title,
        )
        for q in questions()
    ]
    return spark.createDataFrame(rows, SCHEMA)
